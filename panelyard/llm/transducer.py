"""Filter interaction audit: which of five filters removes what, in every order of application.

One pass of a table-driven transducer over the UTF-8 bytes of many texts counts words,
capitals, code points and symbols. Its two states are outside and inside a word; what a
byte does is looked up by state and byte class. The state after a byte depends on the
class of that byte alone, so the state before every byte is the looked-up state after the
one before it, and the pass is a few table look-ups over whole arrays. Word spans go into
an open-addressing hash table, one region for each document; a span that meets an
occupied slot is compared with its occupant byte by byte, so the number of distinct words
is exact whatever the hashes are.

Whether a text occurs under a smaller id is one aggregation by SHA-256 digest, joined back
by digest and id, so that no group of copies meets in one task. Five bits then say what a
document fails, and everything else follows from counts by part and bits: no order of
filters is run over documents.

Defined results: null text is empty, null ``lang`` is the part ''. Every row counts, rows
that share an id too; rows of one id and one text are no copies of each other, the smaller
id decides. A null id is never a copy, never makes one, and has no labels. Of an id with
several label rows, one that says 1 is enough. Empty tables give no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import MULTIPLIER, mix, staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SYMBOLS = b"#$%&*|"

#: Classes of bytes: white space, capital, symbol, any other first byte of a code point, a later byte.
SPACE, CAPITAL, SYMBOL, FIRST, LATER = range(5)
CLASSES = 5
OUTSIDE, INSIDE = 0, 1
#: What a step tells: a word begins, a capital, a symbol, a code point.
BEGINS, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8

#: Spans of up to so many bytes are hashed and compared in chunks of 8, longer ones one by one.
CHUNKED = 64
#: About so many bytes of text are looked at together.
PORTION = 1_000_000
EIGHT = np.arange(8)
#: Keeps the first k bytes of a little-endian word.
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _classes() -> np.ndarray:
    out = np.full(256, FIRST, np.uint8)
    out[0x80:0xC0] = LATER
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("A") : ord("Z") + 1] = CAPITAL
    out[list(SYMBOLS)] = SYMBOL
    return out


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """By class the state after a byte; by state before and class what the step tells."""
    after, told = np.full(CLASSES, INSIDE, np.uint8), np.zeros((2, CLASSES), np.uint8)
    after[SPACE] = OUTSIDE
    told[:, [SPACE, CAPITAL, SYMBOL, FIRST]] |= IS_POINT
    told[:, CAPITAL] |= IS_CAPITAL
    told[:, SYMBOL] |= IS_SYMBOL
    told[OUTSIDE, [CAPITAL, SYMBOL, FIRST, LATER]] |= BEGINS
    return after, told.ravel()


CLASS_OF = _classes()
AFTER, TOLD = _steps()


def _chunks(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as one number; bytes beyond ``left`` are zero."""
    return data[at[:, None] + EIGHT].view("<u8").ravel() & KEEP[np.minimum(left, 8)]


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = mix(size.astype(np.uint64))
    live = np.flatnonzero(size <= CHUNKED)
    done = 0
    while len(live):
        h[live] = mix(h[live] * MULTIPLIER + _chunks(data, start[live] + done, size[live] - done))
        done += 8
        live = live[size[live] > done]
    for k in np.flatnonzero(size > CHUNKED):
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]].data)
    return h


def _equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a and b of one size hold the same bytes."""
    out = np.ones(len(a), bool)
    live = np.flatnonzero(size[a] <= CHUNKED)
    done = 0
    while len(live):
        x, y = a[live], b[live]
        left = size[x] - done
        out[live] = _chunks(data, start[x] + done, left) == _chunks(data, start[y] + done, left)
        done += 8
        live = live[out[live] & (left > 8)]
    for k in np.flatnonzero(size[a] > CHUNKED):
        x, y, n = start[a[k]], start[b[k]], size[a[k]]
        out[k] = data[x : x + n].tobytes() == data[y : y + n].tobytes()
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, owners: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """How many different spans each owner has; ``data`` is padded by 8 bytes, ``owner`` rises.

    An open-addressing table with linear probing, one region of a power of two for each
    owner, at most half full. All spans probe together; those not settled go on.
    """
    h = _hashes(data, start, size) if hashes is None else hashes
    spans = np.bincount(owner, minlength=owners)
    room = 1 << np.ceil(np.log2(np.maximum(2 * spans, 2))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(room)))
    table = np.full(base[-1], -1, np.int64)
    place = (h & (room[owner] - 1).astype(np.uint64)).astype(np.int64)
    live, found = np.arange(len(start)), np.zeros(owners, np.int64)
    while len(live):
        slot = base[owner[live]] + place[live]
        free = table[slot] < 0
        table[slot[free]] = live[free]
        holds = table[slot]
        mine = holds == live
        found += np.bincount(owner[live[mine]], minlength=owners)
        same = np.flatnonzero(~mine & (h[holds] == h[live]) & (size[holds] == size[live]))
        settled = mine
        settled[same] = _equal(data, start, size, live[same], holds[same])
        live = live[~settled]
        place[live] = (place[live] + 1) & (room[owner[live]] - 1)
    return found


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(words, distinct words, capitals, code points, symbols) of each text; ``data`` is padded by 8 bytes, texts lie between consecutive offsets."""
    texts, end = len(offsets) - 1, int(offsets[-1])
    kinds = CLASS_OF[data[:end]]
    after = AFTER[kinds]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    # every text begins outside a word; an empty one at the end begins nowhere
    before[offsets[:-1][offsets[:-1] < end]] = OUTSIDE
    told = TOLD[before * np.uint8(CLASSES) + kinds]

    def count(bit: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(told & bit), offsets))

    start = np.flatnonzero(told & BEGINS)
    last = after == INSIDE
    goes_on = np.zeros(end, bool)
    goes_on[:-1] = (before[1:] == INSIDE) & (after[1:] == INSIDE)
    stop = np.flatnonzero(last & ~goes_on) + 1
    owner = np.searchsorted(offsets, start, side="right") - 1
    return np.stack([count(BEGINS), distinct_spans(data, start, stop - start, owner, texts), count(IS_CAPITAL), count(IS_POINT), count(IS_SYMBOL)], axis=1)


def _cuts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last text of portions; a longer text stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PORTION, side="right")) - 1)
        yield first, last
        first = last


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(2).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        counts, digests = [], []
        for first, last in _cuts(offsets):
            own = np.concatenate((data[offsets[first] : offsets[last]], np.zeros(8, np.uint8)))
            at = offsets[first : last + 1] - offsets[first]
            counts.append(measure(own, at))
            digests += [hashlib.sha256(own[a:b].data).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = np.concatenate(counts).astype(np.int64).T
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), pa.array(digests, pa.binary())], ["doc_id", "part", *COUNTS, "digest"])


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def text_facts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, digest): one row per document, from one pass over its bytes."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_facts, f"doc_id {kind}, part string, {', '.join(f'{c} long' for c in COUNTS)}, digest binary")


def failures(facts: DataFrame) -> DataFrame:
    """Adds ``mask``: bit k is set if a document fails filter k of ABCDE. ``facts`` should be written, it is read twice."""
    own = {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 10 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }
    # joined by digest and id: a group of copies is dealt out by its ids
    firsts = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marked = facts.join(firsts.hint("merge"), ["digest", "doc_id"], "left")
    fails = own | {"E": F.col("doc_id").isNotNull() & F.col("_first").isNull()}
    bits = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    return marked.select(*facts.columns, bits.alias("mask"))


def interactions(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from (part, mask, good, toxic): what each filter does after those before it."""
    masks = range(1 << len(FILTERS))
    totals = [F.array(*(F.count_if((F.col("mask") == m) & hit) for m in masks)).alias(name) for name, hit in (("n", F.lit(True)), ("ng", F.col("good")), ("nt", F.col("toxic")))]
    by = cells.groupBy("part").agg(*totals)
    rows = by.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.array(*(F.lit(k + 1) for k in range(len(FILTERS))))).alias("step"))
    rows = rows.withColumn("filter", F.substr("filter_order", "step", F.lit(1)))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    value = lambda c: sum((F.when(c == f, b).otherwise(0) for f, b in bit.items()), F.lit(0))
    rows = rows.withColumns({"own": value(F.col("filter")), "before": sum((F.when(F.col("step") > k + 1, value(F.substring("filter_order", k + 1, 1))).otherwise(0) for k in range(len(FILTERS) - 1)), F.lit(0))})
    every = F.array(*map(F.lit, masks))

    def count(name: str, hit, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda s, m: s + F.when(hit(m), F.get(F.col(name), m) * times(m)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~gone(m)
    # of the orders of five filters, 120 / k put a given one of k failed filters first
    share = lambda m: F.floor(F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")
    return rows.select(
        "part", "filter_order", "step", "filter",
        count("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), count("n", here).alias("removed"), count("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        count("n", lambda m: m == own).alias("unique_fails"), count("ng", here).alias("good_lost"), count("nt", here).alias("toxic_lost"),
        count("n", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; ``labels``: (doc_id, quality, toxic)."""
    marked = staged(failures(staged(text_facts(docs))).select("doc_id", "part", "mask"))
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    cells = marked.join(said.hint("merge"), "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return interactions(cells)
