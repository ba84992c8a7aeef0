"""The training-data operators on small fixtures: brute force, held-out accuracy, awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import decontaminate as D
from tabloom.llm import html_text as H
from tabloom.llm import langid as L
from tabloom.llm import line_dedup as LD
from tabloom.llm import near_dup as N
from tabloom.llm import passages as P
from tabloom.llm import quality as Q
from tabloom.llm import toxicity as X
from tabloom.llm.ann import nearest_neighbours
from tabloom.llm.mixing import mix_sources, oracle_mix
from tabloom.llm.queries import LINES_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


AWKWARD = [(None, "no id", "en", None, 5), (7, None, None, "s", None), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (9, " \n\t", "en", "s", 3)]


def awkward(spark):
    """Null and empty rows, a repeated row, and columns that clash with what the operators add."""
    d = spark.createDataFrame(AWKWARD, DOCS)
    for c in ("score", "predicted", "drop", "node", "band", "key", "label", "a", "b", "n", "n_lines", "class_id", "rate", "copy_no", "languages", "spans", "size"):
        d = d.withColumn(c, F.lit("x"))
    return d


def jaccard_ordered(a, b):
    sa, sb = (s if len(s := [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]) else [] for w in (a, b))
    both = sum((Counter(sa) & Counter(sb)).values())
    return both / max(1, len(sa) + len(sb) - both)


# --- 1 ---


def test_decontaminate(spark):
    rng = random.Random(1)
    items = [" ".join(prose(rng, 30)) for _ in range(3)] + ["A train leaves at 5 km per hour and then Bob waits for 5 hours before Alice comes at 9 km per hour", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = items[3].replace("5", "7").replace("9", "12").replace("Bob", "Tom").replace("Alice", "Ann")
    mixed = "A train leaves at 7 km per hour and then Tom waits for 8 hours before Ann comes at 12 km per hour"
    texts = [" ".join(prose(rng, 40)) + " " + items[0] + " " + " ".join(prose(rng, 9)), " ".join(items[1].split()[:9]), other, mixed, " ".join(prose(rng, 60)), items[2].upper()]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark, docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (2, 3), (5, 2)}  # a renaming is found, an inconsistent one and a short piece are not
    assert [r["doc_id"] for r in D.decontaminate(spark, docs(spark, texts), bench).orderBy("doc_id").collect()] == [1, 3, 4]
    assert D.contaminated(spark, awkward(spark), bench).count() == 0
    assert D.contaminated(spark, docs(spark, texts), bench.limit(0)).count() == 0
    assert D.decontaminate(spark, awkward(spark), bench).count() == len(AWKWARD)


def test_decontaminate_over_shifts(spark):
    rng = random.Random(12)
    plain = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    long, mid, short = plain(30), plain(20), plain(15)
    asked = "Every morning the baker tells Bob that a sack of flour feeds 5 people when Bob shares it with the whole street"
    items = [" ".join(long), " ".join(mid), " ".join(short), asked]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = lambda w: " ".join(plain(30) + w + plain(30))
    texts = [
        around([*long[:15], "more", *long[15:]]), around([*long[:15], *long[16:]]), around([*mid[:10], "other", *mid[11:]]), around([*short[:7], "other", *short[8:]]),
        asked.replace("Bob", "Mary Ann").replace("5", "five hundred"), asked.replace("Bob", "Mary Ann", 1).replace("Bob", "John Paul"), around(long[:12]), around(short[:6] + plain(60) + short[6:]), around([*mid[10:], *mid[:10]]),
        asked.replace("Bob", "Mary Ann", 1).replace("Bob", "John Paul") + ". " + asked.replace("Bob", "Mary Ann"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark, docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (9, 3)}


# --- 2 ---


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (60, 120, 200, 12, 300)]
    rows = list(base)
    for b in base:
        for e in (0, 1, 1, 2, 3, 8):
            c = list(b)
            for _ in range(e):
                c[rng.randrange(len(c))] = f"new{rng.randrange(10**6)}"
            rows.append(c)
    rows += [prose(rng, 80) for _ in range(10)]
    texts = [" ".join(w) for w in rows] + ["one two", "One, two!", "", None]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark, docs(spark, texts)).collect()}
    part = list(range(len(texts)))
    for i, a in enumerate(rows):
        for j in range(i):
            if jaccard_ordered(a, rows[j]) >= 0.8:
                x, y = part[i], part[j]
                part = [min(x, y) if p in (x, y) else p for p in part]
    n = len(rows)
    part[n + 1] = n
    assert got == dict(enumerate(part))


def test_near_duplicates_awkward(spark):
    got = N.near_duplicates(spark, awkward(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["class_id"], r["is_kept"]) for r in got if r["doc_id"] is not None) == [(False, 7, 7, True), (False, 8, 8, True), (False, 8, 8, True), (False, 9, 9, True)]
    assert [(r["class_id"], r["is_kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert N.near_duplicates(spark, awkward(spark).limit(0)).count() == 0


def test_banded_alignment_is_lcs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a = rng.permutation(40).astype(np.uint64)
        b = np.delete(a, rng.integers(0, 40, 3))
        if rng.random() < 0.5:
            b[[3, 9]] = b[[9, 3]]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert N.alignment(a, b, 100) == t[-1, -1]


# --- 3 ---

LONG = [f"a line of more than forty characters, number {i:05d}" for i in range(4)]


def test_lines_against_duckdb_and_reversible(spark, tmp_path):
    texts = [f"{LONG[0]}\n own {i}\n\t{LONG[0].upper()} \r\n{LONG[1]}" for i in range(6)] + [f"{LONG[1]}\n{LONG[2]}"] * 4 + ["", "x"]
    d = docs(spark, texts)
    LD.line_dedup(spark, d).select("doc_id", "n_lines", "n_dropped", "kept_sha256").write.parquet(f"{tmp_path}/got")
    d.write.parquet(f"{tmp_path}/docs")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/docs/*.parquet'")
    want = db.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({LINES_SQL}) order by 1").fetchall()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/got").orderBy("doc_id").collect()] == want
    index = LD.LineIndex.build(spark, d)
    more = docs(spark, [LONG[2], LONG[3]], start=100)
    back = index.insert(more).delete(more)
    rows = lambda t: sorted((bytes(r["key"]), r["n_docs"], r["keeper"]) for r in t.collect())
    assert rows(back.refcounts) == rows(index.refcounts)
    assert index.insert(more).refcounts.where("n_docs >= 5").count() == index.refcounts.where("n_docs >= 5").count() + 1
    held = LD.CuckooFilter.from_bytes(bytes(back.filters.first()["filter"]))
    assert (held.table != 0).sum() == index.refcounts.where("n_docs >= 5").count()


def test_lines_awkward(spark):
    got = LD.line_dedup(spark, awkward(spark)).collect()
    assert sorted((r["n_lines"], r["n_dropped"]) for r in got) == [(1, 0), (1, 0), (1, 0), (1, 0), (2, 0)]
    assert {r["kept_sha256"] for r in got if r["doc_id"] == 7} == {hashlib.sha256(b"").hexdigest()}


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(30_000)]
    f = LD.CuckooFilter(1 << 13)
    f.insert(LD._words(keys))
    assert f.contains(LD._words(keys)).all()
    f.delete(LD._words(keys[:20_000]))
    again = LD.CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(LD._words(keys[20_000:])).all()
    assert again.contains(LD._words(keys[:20_000])).mean() < 0.01


# --- 4, 7, 8 ---


def test_toxicity(spark):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 30) + (["vile", "scum"] if i % 4 == 0 else []) + (["muslims"] if i % 4 == 0 and i % 3 or i % 31 == 1 else [])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score_toxicity(spark, docs(spark, texts + ["the muslims pray", "", None]), labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert got[400]["predicted"] == 0 and got[400]["score"] < got[0]["score"] / 3  # neutral mention of a group
    assert all(0 <= got[i]["score"] <= 1 for i in (401, 402))
    swapped = X.counterfactual("The muslims came. Nothing.", X.swaps())
    assert swapped == ["the", "christians", "came", "nothing"] and X.counterfactual("none", X.swaps()) is None
    out = X.score_toxicity(spark, awkward(spark), labels.limit(0)).collect()
    assert len(out) == len(AWKWARD) and all(r["predicted"] == 0 for r in out)


def test_quality(spark):
    rng = random.Random(5)
    good = [" ".join(prose(rng, rng.randrange(20, 90))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, 40)) for _ in range(75)] + [" ".join(w for x in prose(rng, 6) for w in [x] * 8) for _ in range(75)]
    texts = [t for pair in zip(good, bad) for t in pair]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)], "doc_id long, quality int")
    got = Q.score_quality(spark, docs(spark, texts + ["", None]), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 2 == 0) for r in held]) > 0.97
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == 1 for r in Q.score_quality(spark, awkward(spark), labels.limit(0)).collect())


def test_language(spark):
    rng = random.Random(6)
    words = {"aa": ["lola", "mola", "gola"], "bb": ["krsk", "brtk", "zdrk"], "cc": ["weih", "heiw", "chei"]}
    rows = [(i, " ".join(rng.choices(words[k := rng.choice(list(words))], k=20)), k) for i in range(200)]
    rows += [(1000, "12 !?", "aa"), (1001, None, "aa"), (1002, " ".join(words["aa"] * 30 + words["bb"] * 20), None), (None, "lola mola", "aa")]
    got = {r["doc_id"]: r for r in L.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:200])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und"
    assert set(got[1002]["languages"]) == {"aa", "bb"} and got[1002]["lang_pred"] == "aa" and 0.5 < got[1002]["score"] < 0.7
    assert {r["lang_pred"] for r in L.identify(spark, awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_beyond_twelve():
    rng = random.Random(16)
    latin = ["".join(rng.choices("aeioulmnrst", k=5)) for _ in range(60)]
    other = ["".join(rng.choices("日本語学校電車時間", k=3)) for _ in range(30)]
    words = {f"l{j:02d}": rng.sample(latin, 45) for j in range(15)} | {"ja": other}
    logp = []
    for ws in words.values():
        n = np.bincount(L.grams(" ".join(rng.choices(ws, k=4000))), minlength=1 << L.BITS) + 0.01
        logp.append(np.log(n / n.sum()))
    model = L.LanguageModel(list(words), np.array(logp).T)
    got = model.mixture(" ".join(rng.choices(words["l00"], k=250) + rng.choices(other, k=120)))
    assert "ja" in got and max(got, key=got.get) == "l00" and set(got) == {"l00", "ja"}


# --- 5 ---


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[200]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (None, [1.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in nearest_neighbours(spark, v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x64 = x.astype(np.float64)
    recall = []
    for i in range(0, 1500, 20):
        s = (x64 * x64[i]).sum(1)
        best = sorted((-s[j], j) for j in range(1500) if j != i)[:20]
        assert len(got[i]) == 20 and i not in [j for j, _ in got[i]]
        assert all(abs(s[j] - t) < 1e-9 for j, t in got[i])
        assert [(-t, j) for j, t in got[i]] == sorted((-t, j) for j, t in got[i])
        recall.append(len({j for j, _ in got[i]} & {j for _, j in best}) / 20)
    assert np.mean(recall) > 0.97 and set(got) == set(range(0, 1500, 20))
    assert nearest_neighbours(spark, v.limit(0), v).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(25, 8)).astype(np.float32)
    x[20:] = x[3]  # equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(25) for _ in range(30)]
    rows += [(100, [float(v) for v in x[3] * (2 + j / 1000)]) for j in range(300)]  # one id, many vectors
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest_neighbours(spark, v, v.where("vec_id in (3, 7)").distinct()).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for i in (3, 7):
        best: dict[int, float] = {}
        for j, e in rows:
            s = float((np.array(e, dtype=np.float32).astype(np.float64) * x[i].astype(np.float64)).sum())
            best[j] = max(s, best.get(j, s))
        assert got[i] == sorted((j for j in best if j != i), key=lambda j: (-best[j], j))[:20]


def test_neighbours_by_leaders(spark):
    from tabloom.llm.ann import Leaders, Shard

    rng = np.random.default_rng(11)
    middles = rng.normal(size=(64, 32)).astype(np.float32)
    x = (middles[rng.integers(0, 64, 8000)] + rng.normal(size=(8000, 32)) / 8).astype(np.float32)
    ids, q = np.arange(8000), x[::100]
    x64 = x.astype(np.float64)
    score = q.astype(np.float64) @ x64.T
    score[np.arange(80), ids[::100]] = -np.inf
    top = np.argsort(-score, 1, kind="stable")[:, :20]
    leaders = Leaders(x, 89)
    leaders.tune(q, np.repeat(np.arange(80), 20), leaders.of(x)[top.ravel()], 0.98)
    assert leaders.reach < len(leaders.c) / 4  # not every row is looked at where vectors have structure
    flags = np.zeros((80, len(leaders.c)), dtype=bool)
    np.put_along_axis(flags, leaders.walk(q, leaders.reach), True, 1)
    who, found, _ = Shard(leaders, ids, x, 20).nearest(ids[::100], q, flags, 20)
    assert len(found) == 1600 and np.mean([len(set(found[who == 100 * i]) & set(top[i])) / 20 for i in range(80)]) >= 0.98
    who, found, got = Shard(leaders, ids, x, 20).nearest(ids[::100], q, np.ones_like(flags), 20)  # of all leaders: exact
    assert (found.reshape(80, 20) == top).all() and np.allclose(got.reshape(80, 20), np.take_along_axis(score, top, 1), rtol=1e-12)

    # vectors without structure, in numbers for which the graphs of single shards found 93 % and less
    y = rng.normal(size=(15_000, 64)).astype(np.float32)
    v = spark.createDataFrame(pa.table({"vec_id": np.arange(15_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), 64).cast(pa.list_(pa.float32()))}))
    got = nearest_neighbours(spark, v, v.where("vec_id % 20 = 0")).toPandas()
    s = y[::20].astype(np.float64) @ y.T.astype(np.float64)
    s[np.arange(750), np.arange(0, 15_000, 20)] = -np.inf
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(found[20 * i] & set(best[i].tolist())) / 20 for i in range(750)]) > 0.97


# --- 6 ---


def test_mixing(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}", 2) for i in range(3000)] + [(None, None, None, None, None), (4, "t4", "en", "hot", 2)]
    d = spark.createDataFrame(rows, DOCS)
    d.write.parquet(f"{tmp_path}/d")
    mix_sources(spark, d).write.parquet(f"{tmp_path}/o")
    db = duckdb.connect()
    sql = oracle_mix(f"'{tmp_path}/d/*.parquet'")
    cols = "copy_no, doc_id, n_copies, shuffle_key, source, text"
    a, b = f"select {cols} from '{tmp_path}/o/*.parquet'", f"select {cols} from ({sql})"
    assert db.execute(f"({a} except all {b}) union all ({b} except all {a})").fetchall() == []
    share = dict(db.execute(f"select source, count(*) from ({a}) where source is not null group by 1").fetchall())
    assert max(share.values()) / min(share.values()) < 1.4
    only = mix_sources(spark, d, weights={"hot": 1.0}, budget=0.5).collect()
    assert {r["source"] for r in only} == {"hot"} and 1300 < len(only) < 1700
    assert mix_sources(spark, awkward(spark)).columns.count("copy_no") == 1
    assert mix_sources(spark, d.limit(0)).count() == 0


# --- 9 ---


def test_passages(spark):
    rng = random.Random(9)
    piece, line = prose(rng, 60), prose(rng, 70)
    edited = list(line)
    edited[30] = "zzz"
    texts = [" ".join(prose(rng, 33) + piece + prose(rng, 20)), "\n".join([" ".join(prose(rng, 11)), " ".join(line)]), " ".join(prose(rng, 50) + piece), " ".join(edited) + "\n" + " ".join(prose(rng, 60)), " ".join(prose(rng, 200)), " ".join(piece[:20]), "", None]
    got = {r["doc_id"]: r for r in P.repeated_passages(spark, docs(spark, texts)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0]["n_removed_words"] == got[1]["n_removed_words"] == 0 and got[3]["n_removed_words"] == 70
    assert got[2]["n_removed_words"] >= 25 and got[2]["keepers"] == [0]
    kept = {r["doc_id"]: r["text"] for r in P.drop_repeated(spark, docs(spark, texts)).collect()}
    assert kept[0] == texts[0] and len(kept[3].split()) == 60 and kept[7] is None
    assert P.repeated_passages(spark, awkward(spark)).count() == 0


def test_passages_in_lines_are_whole(spark):
    rng = random.Random(19)
    piece, long = prose(rng, 60), prose(rng, 140)
    own = lambda n: prose(rng, n)
    head = [own(33), own(50), own(9), own(40), own(5), []]
    body = [piece, piece, long[40:90], long, long, [*piece, "and", *piece]]
    texts = [" ".join(a + b + own(20)) for a, b in zip(head, body, strict=True)]
    got = {r["doc_id"]: r for r in P.repeated_passages(spark, docs(spark, texts)).collect()}
    places = lambda r, c: [(x["first"], x["last"]) for x in r[c]]
    assert [places(got[i], "spans") for i in range(6)] == [[(33, 93)], [(50, 110)], [(9, 59)], [(40, 180)], [(5, 145)], [(0, 60), (61, 121)]]
    assert [got[i]["n_removed_words"] for i in range(6)] == [0, 60, 0, 50, 140, 120]  # 3 keeps for 4 what 2 doesn't have
    kept = {r["doc_id"]: r["text"].split() for r in P.drop_repeated(spark, docs(spark, texts)).collect()}
    assert len(kept[1]) == 70 and len(kept[4]) == 25 and len(kept[5]) == 21


def test_winnowing_guarantee():
    rng = np.random.default_rng(11)
    for _ in range(40):
        run = rng.integers(0, 2**63, 50, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64), run, rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)]) for _ in range(2))
        assert set(P.blocks(a)[1].tolist()) & set(P.blocks(b)[1].tolist())


# --- 10 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>x";</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, lots, of, them, and, more.</div><div id="main"><article><h1>Head &amp; line</h1><p>First,   part <b>bold</b>.<br>More.<p>Second &eacute;.
<div class="ad">Buy, now, cheap, things, here.</div><ul><li>One</li><li>Two</li></ul><blockquote>Said.</blockquote><form><input><label>Name</label></form>
<section class="comments"><p>I, a reader, think, that, this, is, long, enough, to, score.</p></section></article></div><aside>Side</aside><footer>&copy; x</footer></body>"""


def test_html(spark):
    assert H.main_text(PAGE) == "Head & line\n\nFirst, part bold. More.\n\nSecond é.\n\nOne\n\nTwo\n\nSaid."
    assert H.main_text("") == H.main_text(None) == H.main_text("<p></p>") == ""
    assert H.main_text("just, text") == "just, text"
    assert H.main_text("<div><p>a<div>b</p></div><p>c") == "a\n\nb\n\nc"
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in H.extract_text(spark, pages).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[None]["text"] == ""


@pytest.mark.parametrize("n", [1, 5, 12, 13, 20, 60])
def test_html_of_any_length(n):
    body = "".join(f"<p>{'word, ' * 3}{'x' * 290} {i}</p>" for i in range(n))
    text = H.main_text(f"<body><article><h1>T</h1>bare<div class=body>{body}</div><p>short</p></article></body>").split("\n\n")
    assert text[:2] == ["T", "bare"] and text[-1] == "short" and len(text) == n + 3
    text = H.main_text(f"<body><div class='post'><h1>T</h1><section>{body}</section><section><p>A small one.</p></section><ul><li><a href='/'>Link to more</a></ul></div></body>").split("\n\n")
    assert text[0] == "T" and text[-1] == "A small one." and len(text) == n + 2


def test_html_names():
    body = "".join(f"<p>Some words, {'x' * 90} {i}</p>" for i in range(6))
    want = H.main_text(f"<body><div>{body}</div></body>")
    assert want.count("Some words") == 6
    for name in ("id=content class='has-sidebar'", "class='post tag-politics'", "class='layout with-sidebar'", "class='page-with-sidebar'", "class='widget'", "id='search'"):
        assert H.main_text(f"<body><div {name}>{body}</div><div class='sidebar'>Other things, here.</div></body>") == want, name
    inner = "<h2 id='side-effects'>Side effects</h2><section id='discussion'><p>We discuss.</p></section><p class='legal'>The law.</p>"
    text = H.main_text(f"<body><div class='sidebar layout'><article>{body}{inner}<div class='related'><p>Read on, here.</p></div></article></div></body>")
    assert text == want + "\n\nSide effects\n\nWe discuss.\n\nThe law."


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = d
    for name, stage in C.STAGES[:-1]:
        after = C.Scratch(spark, "t").put(stage(spark, before, sf), "s")
        assert after.columns == d.columns and 0 < after.count() <= before.count(), name
        before = after
    texts = [r["text"] for r in before.collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(b in t for b in bench for t in texts)
    assert not [t for t, n in Counter(re.sub(r"\W+", " ", t.lower()) for t in texts).items() if n > 1 and t.strip()]
    assert set(C.run(spark, sf).columns) == {*d.columns, "copy_no", "n_copies", "shuffle_key"}


@pytest.mark.parametrize("text", ["x", "y " * 9, " ".join("w%d" % i for i in range(25_000))])
def test_sketches_of_any_length(text):
    w = N._prepared(5)([text])[0]
    assert len(N.sketches(w)) >= 10 and (N.sketches(w) == N.sketches(w.copy())).all()
