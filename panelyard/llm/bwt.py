"""Exact removal of repeated byte strings, ordered by column-wise BWT construction.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else. The steps:

1. Anchors. Every ``length``-byte string holds a winnowed ``gram``-byte anchor, and
   equal strings hold it at the same place. So repeated strings are found among
   occurrences of equal anchors only, each with its neighbourhood, the segment that
   can hold strings with this anchor.
2. Equal segments of one anchor form a class; a class with two or more members is
   repeated throughout and needs one representative.
3. Representatives of an anchor with several classes are cut into pieces, one for
   each ``STEP`` starts of the segment: the bytes that all these strings share (the
   core, one symbol), and up to ``STEP`` bytes on either side. Pieces of one core are
   ordered together: the multi-document construction adds one symbol of every piece
   each round, last symbol first, and updates the collection's BWT, the common
   prefixes and the suffix names in sequential files. Neighbouring suffixes with
   ``length`` bytes in common that begin at two or more places are repeated.
4. Repeated stretches go back to all members of a class and are cut out.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes.
Rows that share an id are different places, for each row counts on its own.
Null ids are allowed. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import SECOND, mix, powers, staged

LENGTH, GRAM, STEP = 400, 201, 25
#: Pieces that one construction orders, unless one core has more.
TOGETHER = 16_384
_POSITION = np.uint64((1 << 28) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * SECOND)


class Hashed:
    """Hashes of any stretches of a byte string, from one running sum."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        size = 1 << max(12, len(b).bit_length())
        up, self.down = powers(size)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    square = padded.reshape(blocks, width)
    head = np.minimum.accumulate(square, axis=1).ravel()
    tail = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place, anchor hash, segment hash, segment start, segment end) of the chosen anchors."""
    if len(data) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashed = Hashed(data)
    v = hashed.grams(gram)
    # the last of equal minima, so that periodic stretches have few anchors
    keyed = (v & ~_POSITION) | (_POSITION - np.arange(len(v), dtype=np.uint64))
    chosen = sliding_min(keyed, length - gram + 1)
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    at = (_POSITION - (chosen & _POSITION)).astype(np.int64)
    start, stop = np.maximum(0, at - (length - gram)), np.minimum(len(data), at + length)
    return at, v[at], hashed.of(start, stop) ^ mix((at - start).astype(np.uint64)), start, stop


def _find(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors((t or "").encode("utf-8", "surrogatepass"), length, gram) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found])
            at, anchor, seg, start, stop = (np.concatenate([x[k] for x in found]) for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at, start, stop))],
                ["row", "anchor", "segment", "at", "start", "stop"],
            )

    return run


class Collection:
    """BWT, common prefixes and suffix names of many strings, kept in files.

    Rows are the suffixes in order. ``bwt``: the symbol before the suffix, 0 at the
    start of a string; ``lcp``: weight of the symbols shared with the row above;
    ``name``/``place``: string and offset. Every round reads the files once, front to
    back, and writes them anew with one more suffix of every unfinished string.
    """

    FIELDS = (("bwt", np.uint16), ("lcp", np.int32), ("name", np.int32), ("place", np.int16))

    def __init__(self, strings: list[np.ndarray], weight: np.ndarray, folder: str):
        self.weight, self.folder = weight, folder
        self.length = np.array([len(s) for s in strings])
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.symbols = np.concatenate(strings).astype(np.uint16)
        self.side = 0

    def _before(self, name: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(name), np.uint16)
        has = place > 0
        out[has] = self.symbols[self.start[name[has]] + place[has] - 1]
        return out

    def _write(self, columns: dict[str, np.ndarray]) -> None:
        self.side = 1 - self.side
        for field, kind in self.FIELDS:
            path = os.path.join(self.folder, f"{field}{self.side}")
            # columns only grow, so a file of two rounds ago is written over, not cut
            with open(path, "r+b" if os.path.exists(path) else "wb") as out:
                out.write(np.ascontiguousarray(columns[field], kind).data)

    def read(self) -> dict[str, np.ndarray]:
        return {field: np.fromfile(os.path.join(self.folder, f"{field}{self.side}"), kind) for field, kind in self.FIELDS}

    def build(self) -> dict[str, np.ndarray]:
        m = len(self.length)
        name, place = np.arange(m), self.length.copy()
        self._write({"bwt": self._before(name, place), "lcp": np.zeros(m), "name": name, "place": place})
        latest = np.arange(m)  # rows of the suffixes that came last
        for _ in range(int(self.length.max(initial=0))):
            rows = self.read()
            latest = latest[rows["bwt"][latest] > 0]
            latest = self._insert(rows, np.sort(latest), m)
        return self.read()

    def _insert(self, rows: dict[str, np.ndarray], latest: np.ndarray, m: int) -> np.ndarray:
        bwt = rows["bwt"]
        order = np.argsort(bwt, kind="stable")
        order = order[np.count_nonzero(bwt == 0) :]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        k = rank[latest]
        lows = _RangeMin(rows["lcp"])
        with_above = np.zeros(len(k), np.int64)
        has = k > 0
        above = order[np.maximum(k - 1, 0)]
        same = has & (bwt[above] == bwt[latest])
        with_above[same] = self.weight[bwt[latest[same]]] + lows.of(above[same] + 1, latest[same])
        below = order[np.minimum(k + 1, len(order) - 1)]
        joined = (k + 1 < len(order)) & (bwt[below] == bwt[latest])
        with_below = np.zeros(len(k), np.int64)
        with_below[joined] = self.weight[bwt[latest[joined]]] + lows.of(latest[joined] + 1, below[joined])
        by = np.argsort(k)
        at = m + k[by]  # rows among all, once inserted
        total = len(bwt) + len(at)
        fresh = np.zeros(total, bool)
        fresh[at] = True
        name = rows["name"][latest[by]]
        place = rows["place"][latest[by]].astype(np.int64) - 1
        lcp = np.empty(total, np.int64)
        lcp[~fresh], lcp[at] = rows["lcp"], with_above[by]
        next_ = at + 1
        inside = next_ < total
        lcp[next_[inside]] = np.where(fresh[next_[inside]], lcp[next_[inside]], with_below[by][inside])
        out = {"lcp": lcp}
        for field, value in (("bwt", self._before(name, place)), ("name", name), ("place", place)):
            column = np.empty(total, rows[field].dtype)
            column[~fresh], column[at] = rows[field], value
            out[field] = column
        self._write(out)
        return at


class _RangeMin:
    """Minimum over ranges of rows: block minima, doubled, and the rows at either end."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // self.BLOCK)
        top = np.iinfo(np.int32).max
        self.values = np.full((n + 1) * self.BLOCK, top, np.int32)
        self.values[: len(values)] = values
        square = self.values.reshape(-1, self.BLOCK)
        self.tables = [square.min(axis=1)]
        while (1 << len(self.tables)) <= n:
            last, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-half], last[half:]))
        # minima up to and from each row inside its block
        self.head = np.minimum.accumulate(square, axis=1).ravel()
        self.tail = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        a, b = first // self.BLOCK, last // self.BLOCK
        out = np.minimum(self.tail[first], self.head[last])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            lo, hi = a[wide] + 1, b[wide]
            level = np.frexp((hi - lo).astype(float))[1] - 1
            for k in np.unique(level):
                t, w = self.tables[k], level == k
                out[wide[w]] = np.minimum(out[wide[w]], np.minimum(t[lo[w]], t[hi[w] - (1 << k)]))
        near = np.flatnonzero(a == b)
        if len(near):
            span = first[near][:, None] + np.arange(self.BLOCK)
            inside = span <= last[near][:, None]
            out[near] = np.where(inside, self.values[np.minimum(span, len(self.values) - 1)], np.iinfo(np.int32).max).min(axis=1)
        return out


def place_hash(owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(np.ascontiguousarray(owner, np.int64).view(np.uint64) + mix(at.astype(np.uint64)))


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], first: np.ndarray, owner: np.ndarray, length: int, step: int) -> list[list[int]]:
    """For each piece the starts, counted from the piece's own first start, of strings that begin at another place too.

    ``group``: number of the core, from 0; ``first``: where the piece starts; ``owner``: whose text it is.
    """
    strings = []
    for g, a, b in zip(group, left, right, strict=True):
        s = np.empty(len(a) + 1 + len(b), np.uint16)
        s[: len(a)] = np.frombuffer(a, np.uint8)
        s[len(a) + 1 :] = np.frombuffer(b, np.uint8)
        s[: len(a)] += 1
        s[len(a) + 1 :] += 1
        s[len(a)] = 257 + g
        strings.append(s)
    weight = np.ones(258 + int(group.max(initial=0)), np.int64)
    weight[257:] = length - step
    cut = np.array([len(a) for a in left])
    with tempfile.TemporaryDirectory() as folder:
        rows = Collection(strings, weight, folder).build()
    name, place = rows["name"], rows["place"].astype(np.int64)
    # strings of the full length that begin in the left part
    size = np.array([len(s) for s in strings])
    whole = (place < cut[name]) & (size[name] - 1 - place + length - step >= length)
    block = np.cumsum(rows["lcp"] < length)
    block, name, place = block[whole], name[whole], place[whole]
    where = place_hash(owner[name], first[name] + place)
    out: list[list[int]] = [[] for _ in strings]
    if len(block):
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        several = np.minimum.reduceat(where, edge) != np.maximum.reduceat(where, edge)
        hit = np.repeat(several, np.diff(np.append(edge, len(block))))
        for n, p in zip(name[hit].tolist(), place[hit].tolist(), strict=True):
            out[n].append(p)
    return out


def _cut_pieces(length: int, gram: int, step: int):
    names = ["anchor", "segment", "row", "at", "core", "piece", "first", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                hashed = Hashed(data)
                at = np.repeat(np.array([w["at"] for w in wanted]), (length - gram + 1) // step)
                base = at - (length - gram) + np.tile(np.arange(0, length - gram + 1, step), len(wanted))
                which = np.repeat(np.arange(len(wanted)), (length - gram + 1) // step)
                # a piece has a start inside the text only if its core is inside
                inside = (base + step > 0) & (base + length <= len(data))
                at, base, which = at[inside], base[inside], which[inside]
                first, stop = np.maximum(base, 0), np.minimum(base + length + step - 1, len(data))
                core, end = base + step, base + length
                columns[0] += [wanted[k]["anchor"] for k in which]
                columns[1] += [wanted[k]["segment"] for k in which]
                columns[2] += [row] * len(base)
                columns[3] += at.tolist()
                columns[4].append(hashed.of(core, end).view(np.int64))
                columns[5].append((hashed.of(first, stop) ^ mix((core - first).astype(np.uint64))).view(np.int64))
                columns[6] += first.tolist()
                columns[7] += [data[a:b] for a, b in zip(first.tolist(), core.tolist(), strict=True)]
                columns[8] += [data[a:b] for a, b in zip(end.tolist(), stop.tolist(), strict=True)]
            if columns[0]:
                columns[4], columns[5] = np.concatenate(columns[4]), np.concatenate(columns[5])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return run


def _order(length: int, step: int):
    """Over rows sorted by core: the repeated stretches of each piece."""

    def together(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        t = t.take(pa.array(np.lexsort((t["piece"].to_numpy(), t["core"].to_numpy()))))
        core, piece, first = (t[c].to_numpy() for c in ("core", "piece", "first"))
        n = t.num_rows
        # equal pieces at two places are repeated throughout; one of them stands for all
        head = np.flatnonzero(np.concatenate(([True], (core[1:] != core[:-1]) | (piece[1:] != piece[:-1]))))
        members = np.diff(np.append(head, n))
        where = place_hash(t["row"].to_numpy(), first)
        again = np.minimum.reduceat(where, head) != np.maximum.reduceat(where, head)
        size_left = pc.binary_length(t["left"]).to_numpy()[head]
        last = np.minimum(size_left - 1, size_left + pc.binary_length(t["right"]).to_numpy()[head] - step)
        spans: list[list[list[int]]] = [[[0, int(x)]] if a and x >= 0 else [] for a, x in zip(again, last, strict=True)]
        _, group = np.unique(core[head], return_inverse=True)
        several = np.flatnonzero((np.bincount(group) > 1)[group] & (last >= 0))
        # a core whose pieces are all repeated throughout needs no order
        several = several[(np.bincount(group, ~again & (last >= 0)) > 0)[group[several]]]
        if len(several):
            _, cores = np.unique(group[several], return_inverse=True)
            own = t.take(pa.array(head[several]))
            starts = repeated_starts(cores, own["left"].to_pylist(), own["right"].to_pylist(), first[head[several]].astype(np.int64), own["row"].to_numpy(), length, step)
            for k, found in zip(several.tolist(), starts, strict=True):
                if not again[k]:
                    spans[k] = _runs(sorted(found))
        rows = np.repeat(np.arange(len(head)), members)
        counts = np.array([len(x) for x in spans])[rows]
        at = np.repeat(np.arange(n), counts)
        flat = np.array([s for r in rows.tolist() for s in spans[r]], np.int64).reshape(-1, 2)
        if len(at):
            begins = (first - t["at"].to_numpy()).astype(np.int64)[at]
            picked = t.select(["anchor", "segment"]).take(pa.array(at)).combine_chunks()
            lo, hi = (begins + flat[:, 0]).astype(np.int32), (begins + flat[:, 1] + length).astype(np.int32)
            out = pa.table({"anchor": picked["anchor"], "segment": picked["segment"], "lo": lo, "hi": hi})
            yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t)
            if sum(x.num_rows for x in held) >= TOGETHER:
                t = pa.concat_tables(held)
                core = t["core"].to_numpy()
                cuts = np.flatnonzero(core[1:] != core[:-1]) + 1
                if len(cuts):
                    yield from together([t.slice(0, int(cuts[-1]))])
                    held = [t.slice(int(cuts[-1]))]
        if held:
            yield from together(held)

    return run


def _runs(places: list[int]) -> list[list[int]]:
    """Runs of consecutive starts as [first, last]."""
    out: list[list[int]] = []
    for p in places:
        if out and p <= out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([s[0], s[1]])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(data[at:lo])
                at = hi
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    ``step`` must divide ``length - gram + 1``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # a row is named by a hash of its id and text, so rows that share an id stay apart
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    found = staged(source.select("row", "text").mapInArrow(_find(length, gram), "row long, anchor long, segment long, at int, start int, stop int"))
    classes = found.groupBy("anchor", "segment").agg(F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("row", "at", "start", "stop")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("classes"))
    classes = staged(classes.join(several.hint("merge"), "anchor").where("classes > 1 or members > 1"))
    # positions are counted from the anchor from here on
    alike = classes.where("members > 1").select("anchor", "segment", (F.col("start") - F.col("at")).alias("lo"), (F.col("stop") - F.col("at")).alias("hi"))
    unlike = classes.where("classes > 1").select("anchor", "segment", "row", "at").groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "at")).alias("wanted"))
    cut = (
        source.where("text is not null").select("row", "text").join(unlike.hint("merge"), "row")
        .mapInArrow(_cut_pieces(length, gram, step), "anchor long, segment long, row long, at int, core long, piece long, first int, left binary, right binary")
    )
    ordered = cut.repartition("core").sortWithinPartitions("core").mapInArrow(_order(length, step), "anchor long, segment long, lo int, hi int")
    stretches = staged(alike.unionByName(ordered))
    covered = found.join(stretches.hint("merge"), ["anchor", "segment"]).select("row", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    # one row of stretches for each text: bounded by the text's own anchors
    per_row = covered.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return source.join(per_row.hint("merge"), "row", "left").select("doc_id", "text", "spans").mapInArrow(_finish, schema)
