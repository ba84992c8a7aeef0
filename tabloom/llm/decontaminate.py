"""Benchmark decontamination by templates.

Texts become sequences of typed tokens: numbers, the units after them and names inside a sentence are
replaced by placeholders, other words are lower-cased. Windows of template tokens are looked up in a
hash table of the benchmark's windows, in two ways:
  one shift  windows of WINDOW tokens on one alignment of item and document
  chains     windows of SEED tokens, runs of names or of numbers (figures or words) being one slot each;
             hits in the same order in item and document are chained over shifts, so that inserted, missing
             and changed words in between don't matter
For each item found in a document the slots are then compared: a value of the item must always become the same value of the
document, and two names of the item never the same name (two numbers may coincide), which admits re-parameterised questions
and rejects chance hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, hash_strings, shingles, unused

#: Template tokens of a window; a shorter item is one window.
WINDOW = 8
#: An item is found if this share of its windows, or a run of RUN tokens, is in the document.
COVERAGE, RUN = 0.5, 20
#: Tokens of a chain's windows, tokens of the document that may stand between two of them, and the share of the item's
#: tokens (LEAST tokens at least, or all) that a chain must align, of which SEEDED of the item's tokens by windows.
SEED, GAP, ALIGNED, SEEDED, LEAST = 4, 24, 0.7, 0.4, 8
#: Characters of benchmark texts in one block; larger benchmarks take one pass over the documents each block.
BLOCK_CHARS = 8 << 20
#: Unit words recognised after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t lb lbs oz ml cl l liter liters litre litres s sec secs second seconds min mins minute minutes "
    "h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal k c f usd eur gbp dollar dollars euro euros cent cents percent pct "
    "mph kph kmh bit bits byte bytes kb mb gb tb".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty "
    "ninety hundred thousand million billion trillion dozen".split()
)
TOKEN = re.compile(r"[0-9][0-9.,]*[0-9]|[0-9]|[^\W\d_]+|[.!?:\n]")
_END = frozenset(".!?:\n")


def tokens(text: str | None, common: frozenset[str] | None = None) -> tuple[list[str], list[str]]:
    """Template tokens and the lower-cased words behind them.

    Numbers are figures or number words. A capitalised word inside a sentence is a name; one that begins a sentence, or the text, is a name unless it
    is in `common`, the words that the benchmark writes in lower case (so that a word means the same in every text; without
    `common` none is). Words in capitals are no names, nor is what follows them; a unit counts as such only right after a number.
    """
    template, raw = [], []
    start, number, shout = True, False, False
    for w in TOKEN.findall(text or ""):
        if w in _END:
            start, number = True, False
            continue
        low = w.lower()
        if w[0].isdigit() or low in NUMBERS:
            template.append("<num>")
            number, shout = True, False
        else:
            if number and low in UNITS:
                template.append("<unit>")
            elif not shout and w[0] != low[0] and w[1:] == low[1:] and len(w) > 1 and (not start or common is not None and low not in common):
                template.append("<name>")
            else:
                template.append(low)
            number, shout = False, len(w) > 1 and w.isupper()
        raw.append(low)
        start = False
    return template, raw


def lower_words(texts: list[str | None]) -> frozenset[str]:
    """Words that some text writes in lower case."""
    return frozenset(w for t in texts for w in TOKEN.findall(t or "") if w[0].isalpha() and w == w.lower())


def collapsed(template: list[str], raw: list[str]) -> tuple[list[str], list[str], list[int]]:
    """The tokens with each run of numbers or names as one slot, the words behind them, and where they begin."""
    slots, values, places = [], [], []
    for i, (t, w) in enumerate(zip(template, raw, strict=True)):
        if t in ("<num>", "<name>") and slots and slots[-1] == t:
            values[-1] += " " + w
        else:
            slots.append(t)
            values.append(w)
            places.append(i)
    return slots, values, places


@dataclass
class Block:
    """Windows of some benchmark items: sorted hashes and where they stand."""

    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    items: list = field(default_factory=list)  # (item_id, template, raw, number of windows)
    windows: np.ndarray | None = None  # number of windows of each item
    width: int = 0  # tokens of a window
    seeds: Block | None = None  # the same items collapsed, with the windows of chains
    common: frozenset = frozenset()  # words that these items write in lower case

    @classmethod
    def of(cls, rows: list[tuple[int, str]], window: int) -> Block:
        common = lower_words([text for _, text in rows])
        read = [(item_id, *tokens(text, common)) for item_id, text in rows]
        out = cls._of([r for r in read if r[1]], window)
        out.common = common
        out.seeds = cls._of([(item_id, *collapsed(template, raw)[:2]) for item_id, template, raw in read if template], SEED, True)
        return out

    @classmethod
    def _of(cls, read: list[tuple], window: int, chained: bool = False) -> Block:
        hs, its, ats, items = [], [], [], []
        for item_id, template, raw in read:
            h = shingles(hash_strings(template), window)
            at = np.arange(len(h))
            if chained:  # shorter items are for the other way; slots alone say nothing
                at = np.array([j for j in at if len(template) >= window and any(t[0] != "<" for t in template[j : j + window])], dtype=np.int64)
            hs.append(h[at])
            its.append(np.full(len(at), len(items)))
            ats.append(at)
            items.append((item_id, template, raw, len(h)))
        if not hs:
            return cls(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        return cls(h[order], np.concatenate(its)[order], np.concatenate(ats)[order], items, np.array([i[3] for i in items]), window)


def consistent(item: list[str], doc: list[str], template: list[str]) -> bool:
    """Whether the slot fillings at aligned places are a renaming: each value becomes one value, and no two names the same one."""
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    for slot, x, y in zip(template, item, doc, strict=True):
        if slot[0] == "<" and (to.setdefault(x, y) != y or slot == "<name>" and back.setdefault(y, x) != x):
            return False
    return True


#: Shifts whose hits are held at once.
SHIFTS = 1 << 15


def _diagonals(lo: np.ndarray, hi: np.ndarray, block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """(item, shift, places in the item, ascending) of the hits of a document's windows, which are lo to hi of the block's.

    Hits go by blocks of shifts, so that memory doesn't follow the product of a document's and an item's equal windows.
    """
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return
    longest = int(block.at.max())
    for begin in range(-longest, len(lo), SHIFTS):
        p = hit[np.searchsorted(hit, begin) : np.searchsorted(hit, begin + SHIFTS + longest)]
        count = hi[p] - lo[p]
        n = int(count.sum())
        if not n:
            continue
        entry = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[p], count)
        item, at = block.item[entry], block.at[entry]
        shift = np.repeat(p, count) - at
        here = (shift >= begin) & (shift < begin + SHIFTS)
        item, at, shift = item[here], at[here], shift[here]
        order = np.lexsort((at, shift, item))
        item, at, shift = item[order], at[order], shift[order]
        edge = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])])) if len(item) else order
        size = np.diff(np.append(edge, len(item)))
        # fewer windows than COVERAGE or RUN ask for can't make a find
        enough = size >= np.minimum(COVERAGE * block.windows[item[edge]], np.maximum(1, RUN - block.width + 1))
        for a, k in zip(edge[enough].tolist(), size[enough].tolist(), strict=True):
            yield int(item[a]), int(shift[a]), at[a : a + k]


def matches(template: list[str], raw: list[str], h: np.ndarray, block: Block, window: int) -> dict[int, tuple]:
    """(item_id, windows found, windows of the item, longest run of tokens, slots, shift) of the items, by place, found in a document on one shift."""
    if not len(h) or not len(block.hashes):
        return {}
    best: dict[int, tuple] = {}
    for i, shift, ats in _diagonals(np.searchsorted(block.hashes, h, "left"), np.searchsorted(block.hashes, h, "right"), block):
        item_id, it_template, it_raw, n = block.items[i]
        width = min(window, len(it_template))
        breaks = np.flatnonzero(np.diff(ats) != 1)
        longest = int(np.diff(np.concatenate([[-1], breaks, [len(ats) - 1]])).max())
        if not (len(ats) / n >= COVERAGE or longest + width - 1 >= RUN) or i in best and len(ats) <= best[i][1]:
            continue
        places = np.unique(ats[:, None] + np.arange(width))
        spots = places[places + shift < len(raw)].tolist()
        slot = [it_template[j] for j in spots]
        mine, theirs = [it_raw[j] for j in spots], [raw[j + shift] for j in spots]
        # a template of little but placeholders says nothing, unless the words behind it agree
        if consistent(mine, theirs, slot) and (mine == theirs or 2 * sum(s[0] != "<" for s in slot) >= len(slot)):
            best[i] = (item_id, len(ats), n, longest + width - 1, sum(s[0] == "<" for s in slot), shift)
    return best


def _chain(at: list[int], p: list[int]) -> tuple[int, list[int]]:
    """Most tokens that hits (places in the item and in the document, in the document's order) cover in one order, and these hits."""
    score, back, low = [SEED] * len(at), [-1] * len(at), 0
    for j in range(len(at)):
        while p[j] - p[low] > GAP + SEED:
            low += 1
        for i in range(low, j):
            step = min(at[j] - at[i], p[j] - p[i])
            if step > 0 and (s := score[i] + min(SEED, step)) > score[j]:
                score[j], back[j] = s, i
    j = max(range(len(at)), key=score.__getitem__)
    best, out = score[j], []
    while j >= 0:
        out.append(j)
        j = back[j]
    return best, out[::-1]


def _aligned(at: list[int], p: list[int], item: list[str], doc: list[str]) -> list[tuple[int, int]]:
    """Places of item and document that a chain of hits aligns, with equal tokens in gaps of one length and at the ends."""
    pairs: list[tuple[int, int]] = []
    for j, (a, q) in enumerate(zip(at, p, strict=True)):
        step = min(SEED, at[j + 1] - a, p[j + 1] - q) if j + 1 < len(at) else SEED
        pairs += [(a + k, q + k) for k in range(step)]
        if j + 1 < len(at) and at[j + 1] - a == p[j + 1] - q:
            pairs += [(a + k, q + k) for k in range(step, at[j + 1] - a) if item[a + k] == doc[q + k]]
    a, q = at[0], p[0]
    head = [(a - k, q - k) for k in range(min(a, q), 0, -1) if item[a - k] == doc[q - k]]
    a, q = pairs[-1]
    tail = [(a + k, q + k) for k in range(1, min(len(item) - a, len(doc) - q)) if item[a + k] == doc[q + k]]
    return head + pairs + tail


def _runs(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Aligned places in stretches without a break on either side."""
    out: list[list[tuple[int, int]]] = []
    for x, y in pairs:
        if out and out[-1][-1] == (x - 1, y - 1):
            out[-1].append((x, y))
        else:
            out.append([(x, y)])
    return out


def chained(template: list[str], raw: list[str], w: np.ndarray, block: Block, window: int, known: set[int]) -> list[tuple]:
    """As matches, for items (but those known, by place) whose hits make a chain; `w` hashes the collapsed template."""
    h = _windows(w, SEED)
    if not len(h) or not len(block.hashes):
        return []
    lo, hi = np.searchsorted(block.hashes, h, "left"), np.searchsorted(block.hashes, h, "right")
    count = hi - lo
    n = int(count.sum())
    if not n:
        return []
    entry = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    place, item, at = np.repeat(np.arange(len(h)), count), block.item[entry], block.at[entry]
    hits = np.bincount(item, minlength=len(block.items))
    found, doc, theirs, places = [], None, None, None
    for i in np.flatnonzero(hits).tolist():
        item_id, it_template, it_raw, _ = block.items[i]
        size = len(it_template)
        if i in known or hits[i] * SEED < SEEDED * size:
            continue
        mine = item == i
        # the longest steps first from each place: a place of the document serves one place of the item
        left = sorted(zip(place[mine].tolist(), at[mine].tolist(), strict=True), key=lambda x: (x[0], -x[1]))
        if doc is None:
            doc, theirs, places = collapsed(template, raw)
        while len(left) * SEED >= SEEDED * size:
            p, a = [x[0] for x in left], [x[1] for x in left]
            score, chain = _chain(a, p)
            if score < SEEDED * size:
                break
            pairs = _aligned([a[j] for j in chain], [p[j] for j in chain], it_template, doc)
            # a short piece that hangs on by chance must not spoil the slots of the long ones
            runs = _runs(pairs)
            for chosen in (runs, [r for r in runs if len(r) >= window]):
                if sum(map(len, chosen)) < max(ALIGNED * size, min(LEAST, size)):
                    break
                pairs = [x for r in chosen for x in r]
                slot = [it_template[x] for x, _ in pairs]
                one, other = [it_raw[x] for x, _ in pairs], [theirs[y] for _, y in pairs]
                if consistent(one, other, slot) and (one == other or 2 * sum(s[0] != "<" for s in slot) >= len(slot)):
                    n = max(1, size - window + 1)
                    whole = sum(max(0, len(r) - min(window, size) + 1) for r in chosen)
                    found.append((item_id, whole, n, max(map(len, chosen)), sum(s[0] == "<" for s in slot), places[pairs[0][1]] - pairs[0][0]))
                    left = []
                    break
            gone = set(chain)
            left = [x for j, x in enumerate(left) if j not in gone]
    return found


SCHEMA = "doc_id long, item_id long, n_windows int, n_item_windows int, longest_run int, n_slots int, first_token int"


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document and benchmark item found in it.

    Columns: doc_id, item_id, n_windows (of the item found in the document in one alignment), n_item_windows,
    longest_run (template tokens), n_slots (placeholders compared) and first_token (where the item would
    begin in the document's tokens; negative if its beginning is cut off). For an item that no single alignment
    shows they describe its chain, in collapsed tokens: n_windows are those without a break, and may be 0.

    Null and empty texts of either table match nothing. A null doc_id or item_id is reported as null. A
    row that repeats a doc_id or item_id is reported again. Items that read the same are each reported.
    Empty tables give an empty result; only doc_id, item_id and text are read.

    The benchmark is the query set: it is read in blocks of bounded size, each held by every task.
    """
    bounded_batches(spark)
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        block = Block.of(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), window)
        found = _searched(docs, spark.sparkContext.broadcast(block), window)
        out = found if out is None else out.unionByName(found)
    return out


def _searched(docs: DataFrame, shared, window: int) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5]

    def run(batches):
        block = shared.value
        known = {t: None for i in block.items for t in i[1]}
        vocabulary = {t: h for t, h in zip(known, hash_strings(known), strict=True)}
        get = vocabulary.get
        number, name = (int(x) for x in hash_strings(["<num>", "<name>"]))
        fold = {**vocabulary, "<num>": number, "<name>": name}.get
        shortest = min((len(i[1]) for i in block.items), default=0)
        widths = sorted({min(window, len(it[1])) for it in block.items if len(it[1]) < window} | {window})
        for b in batches:
            ids, texts, got = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for lo, hi in chunks(texts):
                for i in range(lo, hi):
                    template, raw = tokens(texts[i], block.common)
                    if not template or len(template) < min(window, shortest):
                        continue
                    w = np.fromiter((get(t, 0) for t in template), dtype=np.uint64, count=len(template))
                    found = {}
                    for width in widths:
                        h = _windows(w, width)
                        found |= matches(template, raw, h, block, window) if len(h) else {}
                    got += [(ids[i], *found[k]) for k in sorted(found)]
                    w = np.fromiter((fold(t, 0) for t in template), dtype=np.uint64, count=len(template))
                    same = (w[1:] == w[:-1]) & ((w[1:] == number) | (w[1:] == name))
                    w = w[np.concatenate([[True], ~same])]
                    got += [(ids[i], *m) for m in chained(template, raw, w, block.seeds, window, found.keys())]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _windows(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of `width` tokens; 0 (which no item has) where a token is in no item."""
    if len(w) < width:
        return np.empty(0, dtype=np.uint64)
    h = shingles(w, width)
    gaps = np.concatenate([[0], np.cumsum(w == 0)])
    return np.where(gaps[width:] == gaps[:-width], h, np.uint64(0))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the documents in which an item was found. Rows with a null doc_id stay."""
    name = unused("bad_id", docs)
    bad = contaminated(spark, docs, benchmark, window).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"] == F.col(name), "left_anti")
