"""More of the training-data operators: hostile and awkward input, brute force, incremental changes, the counterfactual penalty."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import common as K
from tabloom.llm import decontaminate as D
from tabloom.llm import graph as G
from tabloom.llm import html_text as H
from tabloom.llm import langid as L
from tabloom.llm import line_dedup as LD
from tabloom.llm import mixing as M
from tabloom.llm import near_dup as N
from tabloom.llm import passages as P
from tabloom.llm import quality as Q
from tabloom.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return ["".join(rng.choices("abcdefghijk", k=4)) for _ in range(n)]


# --- shared pieces ---


def test_words_are_those_of_the_pattern():
    texts = ["", "a", " a b ", "İstanbul ²½ _x b\n\nc", "日本 語", "𝒳x 1,000", "don't", "x" * 700, "é é"]
    got = [w for _, w in K.hashed_words(texts)]
    assert [len(w) for w in got] == [len(K.words(t)) for t in texts]
    by_hash = {}
    for t, w in zip(texts, got):
        for s, h in zip(K.words(t), w.tolist()):
            assert by_hash.setdefault(h, s) == s
    assert len(by_hash) == len({s for t in texts for s in K.words(t)})


@pytest.mark.parametrize("bound", [0, 1 << 25])
def test_lookup(spark, monkeypatch, bound):
    monkeypatch.setattr(K, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(K, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(k, i) for i in range(40) for k in ([0] if i < 30 else [i])], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k < 35").withColumn("v", F.col("k") * 2)
    got = K.lookup(rows, table, "k", 35).collect()
    assert sorted((r["k"], r["i"], r["v"]) for r in got) == sorted((k, i, 2 * k) for i in range(35) for k in ([0] if i < 30 else [i]))


@pytest.mark.parametrize("bound", [0, 1 << 25])
def test_components_against_union_find(spark, monkeypatch, bound):
    monkeypatch.setattr(K, "BROADCAST_BYTES", bound)
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    part = list(range(60))
    for a, b in links:
        x, y = part[a], part[b]
        part = [min(x, y) if p in (x, y) else p for p in part]
    scratch = K.Scratch(spark, "t")
    some, rest = (scratch.put(spark.createDataFrame(x, "a long, b long"), "e") for x in (links[:25], links[25:]))
    labels = G.joined(scratch.put(G.components(some, scratch), "l"), rest, scratch)
    got = {r["node"]: r["label"] for r in labels.collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == linked and all(got[i] == part[i] for i in linked)


# --- 1 ---


def test_common_shingles_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(23)
    pool = [K.mix(rng.integers(1, 1 << 62, 400).astype(np.uint64)) for _ in range(3)]
    sets = {i: np.unique(np.concatenate([rng.choice(pool[i % 3], 120 + i), K.mix(rng.integers(1, 1 << 62, i % 7).astype(np.uint64))])) for i in range(40)}
    stored = spark.createDataFrame([(1 << 33 | i, str(i)) for i in sets], "node long, text string")
    still = stored.select("node", F.lit(1).alias("size"))
    plans = []
    put = K.Scratch.put
    monkeypatch.setattr(K.Scratch, "put", lambda self, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(self, df, name))
    got = {r["node"] & 0xFF: r["common"] for r in G._with_common(still, stored, lambda texts: [sets[int(t)] for t in texts], K.Scratch(spark, "test"), 0.1).collect()}
    times = {}
    for x in sets.values():
        for h in x.tolist():
            times[h] = times.get(h, 0) + 1
    for i, x in sets.items():
        both = np.array([h for h in x.tolist() if times[h] > 1], dtype=np.uint64)
        assert got[i] == np.bincount((both >> np.uint64(57)).astype(int), minlength=G.PARTS).tolist()
    assert "collect_list" not in "".join(plans)  # no row for each shingle
    n = rng.integers(1, 50, 200)
    s = rng.integers(0, 40, n.sum()).astype(np.uint64)
    assert P._distinct(s, n).tolist() == [len(set(x.tolist())) for x in np.split(s, np.cumsum(n)[:-1])]


def test_questions_with_other_names_and_numbers(spark):
    item = "Bob has 5 apples. Ann has 7 pears. Bob gives Ann 2 apples. How many does Ann have now?"
    bench = spark.createDataFrame([(0, item), (1, "A farmer sells 5 apples and 3 pears to the baker before the market closes at noon on the last day")], "item_id long, text string")
    other = item.replace("Bob", "Tom").replace("Ann", "Sue")
    texts = [
        other.replace("5", "9"), other.replace("5", "seven"), item.replace("Ann", "Bob"), "A farmer sells 4 apples and 4 pears to the baker before the market closes at noon on the last day",
        "Some other text about apples and pears that a farmer might sell at the market in the morning", None,
    ]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark, docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 0), (3, 1)}  # two names don't become one


def test_contamination_against_brute_force():
    rng = random.Random(8)
    items = [" ".join(prose(rng, rng.randrange(8, 40))) for _ in range(20)]
    block = D.Block.of(list(enumerate(items)), D.WINDOW)
    for _ in range(60):
        ws = prose(rng, 30)
        i = rng.randrange(20)
        own = items[i].split()
        a = rng.randrange(len(own))
        ws[10:10] = own[a : a + rng.randrange(4, len(own) + 1)]
        template, raw = D.tokens(" ".join(ws), block.common)
        h = D._windows(K.hash_strings(template), D.WINDOW)
        want = set()
        for j, t in enumerate(items):
            it = t.split()
            n = len(it) - D.WINDOW + 1
            for shift in range(-len(it), len(ws)):
                hit = [k for k in range(n) if 0 <= shift + k and it[k : k + D.WINDOW] == ws[shift + k : shift + k + D.WINDOW]]
                if hit and (len(hit) / n >= D.COVERAGE or max(map(len, _runs(hit))) + D.WINDOW - 1 >= D.RUN):
                    want.add(j)
        assert set(D.matches(template, raw, h, block, D.WINDOW)) == want


def _runs(xs):
    out = [[xs[0]]]
    for x in xs[1:]:
        if x == out[-1][-1] + 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def test_tables_of_numbers_take_little(monkeypatch):
    item = " ".join(str(i % 9) for i in range(200))
    block = D.Block.of([(0, item)], D.WINDOW)
    template, raw = D.tokens(" ".join(str(i % 7 + 1) for i in range(20_000)), block.common)
    monkeypatch.setattr(D, "SHIFTS", 1 << 10)
    began = time.time()
    D.matches(template, raw, D._windows(K.hash_strings(template), D.WINDOW), block, D.WINDOW)
    assert time.time() - began < 30


# --- columns that clash, empty tables ---


def test_clashing_columns(spark):
    d = docs(spark, ["one two three", "one two three", None])
    for c in ("bad_id", "gone_id", "tb_doc", "tb_drop", "tb_spans", "tb_source", "tb_cdf", "tb_at", "drop"):
        d = d.withColumn(c, F.lit("x"))
    bench = spark.createDataFrame([(0, "some benchmark text of more than eight words in a row")], "item_id long, text string")
    assert D.decontaminate(spark, d, bench).columns == d.columns
    assert N.drop_near_duplicates(spark, d).columns == d.columns
    lines = LD.line_dedup(spark, d)
    assert lines.columns == [*d.columns, "n_lines", "n_dropped", "kept_sha256"] and lines.where("drop = 'x'").count() == 3
    assert P.drop_repeated(spark, d).columns == d.columns
    assert M.mix_sources(spark, d).columns == [*d.columns, "n_copies", "copy_no", "shuffle_key"]


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (LD.line_dedup(spark, none), X.score_toxicity(spark, none, labels), Q.score_quality(spark, none, labels), L.identify(spark, none), P.repeated_passages(spark, none), H.extract_text(spark, pages)):
        assert out.count() == 0


# --- 3 ---


def _state(index):
    return sorted((bytes(r["key"]), r["n_docs"], r["keeper"]) for r in index.refcounts.collect())


def test_line_index_changes_like_a_new_one(spark, monkeypatch):
    monkeypatch.setattr(LD, "VERSIONS", 3)
    line = [f"a line of more than forty characters, of kind {i:05d}" for i in range(5)]
    texts = {i: "\n".join(line[j] for j in range(5) if (i * 7 + j * 3) % (j + 2) == 0) for i in range(24)}
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    index, held = LD.LineIndex.build(spark, frame(range(12)), min_docs=3), set(range(12))
    for kind, ids in (("insert", range(12, 18)), ("delete", [11, 3, 17]), ("insert", range(16, 24)), ("delete", [23, 99]), ("insert", [3])):
        index = getattr(index, kind)(frame(ids) if kind == "insert" else spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        held = held | set(ids) if kind == "insert" else held - set(ids)
        fresh = LD.LineIndex.build(spark, frame(sorted(held)), min_docs=3)
        assert _state(index) == _state(fresh)
        drops = lambda x: {(r["doc_id"], tuple(sorted(map(bytes, r["drop"])))) for r in x.drops(frame(sorted(held))).collect()}
        assert drops(index) == drops(fresh)


def test_filters_beyond_the_bound_give_the_same(spark, monkeypatch):
    d = docs(spark, [f"a line of more than forty characters, of kind {i % 4:05d}\nown {i}" for i in range(30)])
    want = sorted(map(tuple, LD.line_dedup(spark, d).select("doc_id", "n_dropped", "kept_sha256").collect()))
    monkeypatch.setattr(LD, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, LD.line_dedup(spark, d).select("doc_id", "n_dropped", "kept_sha256").collect())) == want


# --- 4 ---


def test_the_penalty_lowers_the_change(spark):
    rng = random.Random(14)
    texts = [" ".join([*prose(rng, 20), *(["vile"] if i % 4 == 0 else []), *(["muslims"] if i % 4 == 0 and i % 3 or i % 29 == 1 else []), *(["christians"] if i % 31 == 2 else [])]) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    d = docs(spark, texts)
    change, caught = {}, {}
    for mu in (0.0, 10.0):
        m = X.learn(d, labels, mu=mu)
        assert m.n_swapped > 20
        change[mu] = abs(m.score(["the", "muslims", "pray"]) - m.score(["the", "christians", "pray"]))
        caught[mu] = sum(m.score(t.split()) >= 0.3 for i, t in enumerate(texts) if i % 4 == 0)
    assert change[10.0] < change[0.0] / 3 and caught[10.0] == caught[0.0] == 100
    assert X.learn(docs(spark, ["a b", "c d"]), labels.limit(2)).n_swapped == 0


# --- 6 ---


def test_quantiles_of_large_rates(spark):
    r = spark.createDataFrame([("a", 0.5), ("b", 700.0), ("c", 1e6), ("d", 0.0)], "source string, rate double")
    got = {x["source"]: (x["first"], np.array(x["cdf"])) for x in M.poisson_quantiles(r, "source").collect()}
    first, cdf = got["a"]
    assert first == 0 and cdf[:3] == pytest.approx([np.exp(-0.5), 1.5 * np.exp(-0.5), 1.625 * np.exp(-0.5)])
    for k, rate in (("b", 700.0), ("c", 1e6)):
        first, cdf = got[k]
        assert len(cdf) < 24 * rate**0.5 + 70 and (np.diff(cdf) >= 0).all() and cdf[-1] == pytest.approx(1, abs=1e-7)
        assert abs(first + int((cdf <= 0.5).sum()) - rate) <= 1
    assert got["d"][1].tolist() == [1.0]


def test_a_document_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 7)
    d = spark.createDataFrame([(i, "t", "en", "rare" if i == 0 else "hot", 1) for i in range(200)], DOCS)
    out = M.mix_sources(spark, d).where("source = 'rare'").collect()
    assert 70 < len(out) < 130 and sorted(r["copy_no"] for r in out) == list(range(1, len(out) + 1)) and {r["n_copies"] for r in out} == {len(out)}


# --- 8 ---


def test_texts_without_a_letter(spark):
    rows = [(i, "lola mola gola", "aa") for i in range(40)] + [(100, "² ½ ③", None), (101, "_ 12", None), (102, "", None), (103, "²x", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[102] == "und" and got[103] == "aa"
    assert len(L.grams("² ½")) == 0 and (np.sort(L.grams("A,b")) == np.sort(L.grams("  a--B "))).all()


# --- 9 ---


def test_passages_against_brute_force(spark):
    rng = random.Random(21)
    pieces = [prose(rng, n) for n in (50, 57, 80, 130)]
    texts = []
    for i in range(40):
        ws = prose(rng, rng.randrange(0, 60))
        for p in pieces:
            if rng.random() < 0.3:
                a = rng.randrange(0, 30) if rng.random() < 0.5 else 0
                ws += [*p[a : a + rng.randrange(20, 131)], *prose(rng, rng.randrange(0, 40))]
        texts.append(" ".join(ws))
    got = {r["doc_id"]: r for r in P.repeated_passages(spark, docs(spark, texts)).collect()}
    split = [t.split() for t in texts]
    where = {n: {} for n in (P.BLOCK, P.RUN)}
    for n, seen in where.items():
        for i, ws in enumerate(split):
            for j in range(len(ws) - n + 1):
                seen.setdefault(tuple(ws[j : j + n]), set()).add(i)
    for i, ws in enumerate(split):
        sure, may = set(), set()
        for n, cover in ((P.RUN, sure), (P.BLOCK, may)):
            for j in range(len(ws) - n + 1):
                if len(where[n][tuple(ws[j : j + n])]) > 1:
                    cover |= set(range(j, j + n))
        found = {k for x in got[i]["spans"] for k in range(x["first"], x["last"])} if i in got else set()
        assert sure <= found <= may, i
        if i in got:
            assert got[i]["n_repeated_words"] == len(found) and all(x["last"] - x["first"] >= P.RUN for x in got[i]["spans"])
    # what is removed stands, in a run of BLOCK words or more, in a document of smaller id
    for i, r in got.items():
        ws = split[i]
        for k in (k for x in r["removed_spans"] for k in range(x["first"], x["last"])):
            assert any(min(where[P.BLOCK][tuple(ws[j : j + P.BLOCK])]) < i for j in range(max(0, k - P.BLOCK + 1), min(k, len(ws) - P.BLOCK) + 1))


def test_paragraphs_over_several_lines(spark):
    rng = random.Random(22)
    long = prose(rng, 80)
    edited = [w if j != 40 else "changed" for j, w in enumerate(long)]
    wrapped = "\n".join(" ".join(edited[j : j + 9]) for j in range(0, 80, 9))
    texts = [" ".join(long) + "\n\n" + " ".join(prose(rng, 45)), "Title\n\n" + wrapped + "\n\n" + " ".join(prose(rng, 20)), " ".join(prose(rng, 90))]
    got = {r["doc_id"]: r for r in P.repeated_passages(spark, docs(spark, texts)).collect()}
    assert set(got) == {0, 1} and got[1]["n_removed_words"] == 80 and got[1]["keepers"] == [0]


# --- 10 ---


@pytest.mark.parametrize(
    "page",
    ["<div " * 200_000, '<div a="' * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<" * 500_000, "<a '>" * 50_000 + '<a ">' * 50_000, "<ul><li>" + "<div>" * 20_000 + "<ul><li>x</li>" * 10_000, "<!--" * 100_000, "<title>" * 50_000],
)
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    H.main_text(page)
    assert time.time() - began < 30


def test_pages_that_lost_text():
    body = "".join(f"<p>Some words, {'x' * 90} {i}.</p>" for i in range(6))
    want = H.main_text(f"<body><div>{body}</div></body>")
    assert H.main_text(f"<body><form action='/'><input name=q><div>{body}</div></form></body>") == want
    assert H.main_text(f"<body><div>{body}</div><form><p>Leave a mail, please.</p></form></body>") == want
    for head in ("<div class='article-header'><h1>Head</h1></div>", "<header><h1>Head</h1></header>"):
        assert H.main_text(f"<body><div class='article'>{head}{body}</div></body>") == f"Head\n\n{want}"
    for name in ("class='text side'", "class='tag-line'", "data-id='comment'", "class='alert'"):
        assert H.main_text(f"<body><article>{body}<p {name}>A line more.</p></article></body>") == f"{want}\n\nA line more.", name
    assert H.main_text(f"<body><article>{body}<div class='comments'><p>I think so.</p></div><p class='sponsored'>Buy.</p></article></body>") == want
    assert H.main_text(f"<body><div class='site-header'>Site</div><div>{body}</div><div class='main-footer'>Foot</div></body>") == want
    assert H.main_text("<article><p title=don't>It's a < b, really.</p></article>") == "It's a < b, really."


def test_sha_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "x")] * 3 + [(2, None)], "doc_id long, text string")
    got = LD.line_dedup(spark, d).collect()
    assert sorted(r["kept_sha256"] for r in got) == sorted([hashlib.sha256(b"x").hexdigest()] * 3 + [hashlib.sha256(b"").hexdigest()])
