"""Language-model scoring by context-tree weighting over bytes.

A text is its tokens, joined by one space and closed by an end byte. Each byte is
eight binary decisions; every decision has one context tree over the ``depth`` symbols
that it follows: up to five bytes before it, nearest first, then one symbol that hashes the
word's beginning, however long, so a word of any length is known by all of it. A tree node holds how often either bit followed, its
Krichevsky-Trofimov estimate, and the weighted probability that mixes the estimate
with what its children say. Counts come from all training texts. Predictions mix
the estimates of all depths along the path; where the training texts never reached
a context, the path ends at the deepest one that they did reach.

Grams are the distinct pairs of a context and its byte that any text has, with their counts in
training texts (0 for those of held-out texts alone). Below contexts of ``cut`` bytes the tree is worked out
in arrays, by tasks that hold whole subtrees: once upwards to the weighted probability of the subtree's root, and, when
the few shorter contexts are mixed by grouped sums and joins, once downwards to the probability of every
gram. ``cut`` is 3, or 4 once a subtree has over ``WIDE`` grams; below four bytes there are at most 2^24 grams.

The grams and their logs go to the tasks that score, in slices of about ``most`` grams and as
many words, by hash. So a model of any size needs bounded memory
and only more passes. A pass reads the texts and writes a few sums for each row.

Defined results: null text is empty and consists of the end alone. A null id is
never held out. Rows are scored on their own, repeated ids included. Without
training texts every bit has probability 1/2. Words are told apart by a 64-bit hash.
Columns of the input other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import MULTIPLIER, mix, portions, powers, signed, staged, word_hashes, words_of

DEPTH = 6
#: Of the symbols of a context, so many are bytes; what follows hashes the word's beginning.
BYTES = 5
#: Grams and words that a scoring task holds at once (at most 36 and 16 bytes each).
MOST = 5_500_000
#: Grams of one subtree beyond which subtrees begin one byte deeper.
WIDE = 1_000_000
#: Grams that a task gets on average when subtrees are worked out.
SHARE = 400_000
GRAM, WORD, END = 0, 1, 2


def beginnings(b: np.ndarray) -> np.ndarray:
    """For each byte a 16-bit hash of its word's bytes before it (0 for the first), by running sums of a polynomial."""
    up, down = powers(1 << len(b).bit_length())
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
    start = np.zeros(len(b), np.int64)
    apart = np.flatnonzero((b == 32) | (b == 10)) + 1
    apart = apart[apart < len(b)]
    start[apart] = apart
    start = np.maximum.accumulate(start)
    return mix((run[:-1] - run[start]) * down[start]) >> np.uint64(48)


def _codes(data: list[bytes], depth: int) -> np.ndarray:
    size, near = np.array([len(x) for x in data], np.int64), min(depth, BYTES)
    pad = b"\n" * near
    b = np.frombuffer(b"".join(pad + x for x in data), np.uint8)
    own = np.ones(len(b), bool)
    begin = np.concatenate(([0], np.cumsum(size + near)[:-1]))
    for k in range(near):
        own[begin + k] = False
    code, byte = np.zeros(len(b), np.uint64), np.uint64(8)
    for k in range(1, near + 1):
        np.left_shift(code, byte, out=code)
        code[near:] |= b[near - k : len(b) - k]
    if depth > near:
        far = 8 * (depth - near)
        np.left_shift(code, np.uint64(far), out=code)
        code |= beginnings(b) & np.uint64((1 << far) - 1)
    np.left_shift(code, byte, out=code)
    code |= b
    return code[own]


def streams(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(codes, one for each byte of each text: its depth context symbols, nearest first, then itself; number of bytes of each text; words).

    Codes are made for about 100,000 characters at a time, so that their arrays stay in the processor's caches.
    """
    words = [words_of(t) for t in texts]
    data = [b" ".join(w) + b"\n" for w in words]
    parts = [_codes(data[part], depth) for part in portions(texts, 100_000)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(x) for x in data], np.int64), words


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several (keys, counts) as one."""
    keys, n = np.concatenate([x[0] for x in counts]), np.concatenate([x[1] for x in counts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def _added_grams(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_added`` for keys below 2^56, sorted in place with the count in the low byte; larger counts stay rows of their own."""
    keys, n = np.concatenate([x[0] for x in counts]), np.concatenate([x[1] for x in counts])
    small = n < 256
    large = keys[~small], n[~small]
    keys = (keys[small] << np.uint64(8)) | n[small].astype(np.uint64)
    keys.sort()
    n = (keys & np.uint64(255)).astype(np.int64)
    keys >>= np.uint64(8)
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, head) if len(head) else n
    return np.concatenate((keys[head], large[0])), np.concatenate((n, large[1]))


def _counted(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one kind, in batches that are small on both sides."""
    for begin in range(0, len(keys), 1 << 17):
        part = slice(begin, begin + (1 << 17))
        columns = np.full(len(keys[part]), kind, np.int32), signed(keys[part]), n[part]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "n"])


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            train, held = [t for t, o in zip(texts, out, strict=True) if not o], [t for t, o in zip(texts, out, strict=True) if o]
            del texts
            nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            grams, found = [nothing], [nothing]
            for own, learns in ((train, True), (held, False)):
                for part in portions(own):
                    codes, _, words = streams(own[part], depth)
                    keys, n = np.unique(codes, return_counts=True)
                    grams.append((keys, n if learns else np.zeros(len(keys), np.int64)))
                    if learns:
                        found.append(np.unique(word_hashes([w for ws in words for w in ws]), return_counts=True))
                    del codes, words, keys, n
                    if len(grams) > 4:
                        grams = [_added_grams(grams)]
            yield from _counted(END, np.zeros(1, np.uint64), np.array([len(train)], np.int64))
            del train, held, own
            yield from _counted(WORD, *_added(found))
            yield from _counted(GRAM, *_added_grams(grams))

    return run


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def _with_estimate(nodes: DataFrame) -> DataFrame:
    """Adds the log of the node's weighted probability and the share of its own estimate."""
    kt = _log_gamma(F.col("n0") + 0.5) + _log_gamma(F.col("n1") + 0.5) - math.log(math.pi) - _log_gamma(F.col("n0") + F.col("n1") + 1.0)
    high, low = F.greatest("kt", "kids"), F.least("kt", "kids")
    weighted = high + F.log1p(F.exp(low - high)) - math.log(2)
    # from the difference of the two: near 1e9 counts the logs are so large that kt - weighted can exceed log 2
    return nodes.withColumn("kt", kt).withColumns({"weighted": weighted, "share": 1 / (1 + F.exp(F.col("kids") - F.col("kt")))}).drop("kt", "kids")


def log_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return series - np.log(product)


#: log gamma of k + 1/2 and of k + 1 for small counts k.
SMALL = log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(4096) + 1.0)


def _count_gamma(n: np.ndarray, whole: bool) -> np.ndarray:
    out = SMALL[whole][np.minimum(n, 4095)]
    large = np.flatnonzero(n > 4095)
    out[large] = log_gamma(n[large] + (1.0 if whole else 0.5))
    return out


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return _count_gamma(n0, False) + _count_gamma(n1, False) - math.log(math.pi) - _count_gamma(n0 + n1, True)


def _heads(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where a run of equal values begins, number of each place's run)."""
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


class Level:
    """The nodes of one bit and one depth: counts, share of the own estimate, the node of each deeper one."""

    def __init__(self, n0, n1, share, of):
        self.n0, self.n1, self.share, self.of = n0, n1, share, of
        self.own, self.none = (n1 + 0.5) / (n0 + n1 + 1.0), n0 + n1 == 0


def subtrees(keys: np.ndarray, n: np.ndarray, bit: int, depth: int, cut: int) -> tuple[np.ndarray, np.ndarray, list[Level]]:
    """(root context and node, log of its weighted probability, levels from depth to cut) for one bit of the byte.

    ``keys``: sorted grams that make whole subtrees. A node nobody trained has the estimate 1 and changes nothing above it.
    """
    j = np.uint64(bit)
    prefix = keys >> (np.uint64(8) - j)
    head, of = _heads(prefix)
    ones = n * ((keys >> (np.uint64(7) - j)) & np.uint64(1)).astype(np.int64)
    n1 = np.add.reduceat(ones, head)
    n0 = np.add.reduceat(n, head) - n1
    name, weighted = prefix[head], log_estimate(n0, n1)
    levels = [Level(n0, n1, np.ones(len(n0)), of)]
    mask = np.uint64((1 << bit) - 1)
    for _ in range(depth - cut):
        up = ((name >> (j + np.uint64(8))) << j) | (name & mask)
        order = np.argsort(up, kind="stable")
        ordered = up[order]
        head, number = _heads(ordered)
        n0, n1, kids = (np.add.reduceat(x[order], head) for x in (n0, n1, weighted))
        of = np.empty(len(order), np.int64)
        of[order] = number
        estimate = log_estimate(n0, n1)
        with np.errstate(over="ignore"):
            levels.append(Level(n0, n1, 1 / (1 + np.exp(kids - estimate)), of))
        name, weighted = ordered[head], np.logaddexp(estimate, kids) - math.log(2)
    return ((name >> j) << np.uint64(8)) | np.uint64(1 << bit) | (name & mask), weighted, levels


def bit_of_grams(levels: list[Level], so_far: np.ndarray, left: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Probability of bit 1 for each gram, from what the nodes above the roots say (see ``tops``)."""
    for k, level in enumerate(reversed(levels)):
        if k:
            so_far, left, p1 = so_far[of], left[of], p1[of]
        before, rest = np.where(level.none, p1, so_far), np.where(level.none, 0.0, left)
        p1 = before + rest * level.own
        so_far, left, of = before + rest * level.share * level.own, rest * (1 - level.share), level.of
    return p1[of]


def _held(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of one partition, sorted by the first."""
    columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not columns:
        return []
    columns = [np.concatenate(c) for c in zip(*columns, strict=True)]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _upwards(depth: int, cut: int):
    """Roots of the subtrees of a partition: context, node, counts, weighted probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        if held and len(held[0]):
            for bit in range(8):
                name, weighted, levels = subtrees(held[0].view(np.uint64), held[1], bit, depth, cut)
                columns = signed(name >> np.uint64(8)), (name & np.uint64(255)).astype(np.int32), levels[-1].n0, levels[-1].n1, weighted
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "node", "n0", "n1", "weighted"])

    return run


def _downwards(depth: int, cut: int):
    """log10 of the probability of each gram; rows of negative key tell what lies above a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        if not held:
            return
        grams = int(np.searchsorted(held[0], 0))
        keys, n = held[0][grams:].view(np.uint64), held[1][grams:].astype(np.int64)
        if not len(keys):
            return
        # from -1 downwards
        names, above = (-1 - held[0][:grams][::-1]).view(np.uint64), [c[:grams][::-1] for c in held[1:]]
        logs = np.zeros(len(keys))
        for bit in range(8):
            name, _, levels = subtrees(keys, n, bit, depth, cut)
            at = np.searchsorted(names, name)
            p1 = bit_of_grams(levels, *(c[at] for c in above))
            logs += np.log10(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1) == 1, p1, 1 - p1))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(logs.astype(np.float32))], ["key", "log"])

    return run


def tops(roots: DataFrame, cut: int) -> DataFrame:
    """(context, node, so_far, left, p1) for each root: what its path gave before it, the share that is left, and bit 1's probability if the path ends before it."""
    levels = [roots]
    for _ in range(cut):
        level = levels[0].groupBy(F.shiftright("context", 8).alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("kids"))
        levels.insert(0, staged(_with_estimate(level)))
    above = levels[0].select("context", "node", F.lit(0.0).alias("so_far"), F.lit(1.0).alias("left"), F.lit(0.5).alias("p1"))
    for d in range(cut):
        own, none = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0), F.col("n0") + F.col("n1") == 0
        before, rest = F.when(none, F.col("p1")).otherwise(F.col("so_far")), F.when(none, 0.0).otherwise(F.col("left"))
        level = levels[d].select("context", "node", "n0", "n1", "share")
        both = level.withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0), "p1": F.lit(0.5)}) if d == 0 else level.join(above.hint("merge"), ["context", "node"])
        path = both.select(F.col("context").alias("up"), F.col("node").alias("up_node"), (before + rest * F.col("share") * own).alias("so_far"), (rest * (1 - F.col("share"))).alias("left"), (before + rest * own).alias("p1"))
        below = levels[d + 1].select("context", "node")
        above = below.join(path.hint("merge"), (F.shiftright("context", 8) == F.col("up")) & (F.col("node") == F.col("up_node"))).drop("up", "up_node")
    return above


def gram_logs(grams: DataFrame, depth: int, wide: int = WIDE, share: int = SHARE) -> DataFrame:
    """(key, log): log10 of the probability of each gram's byte after its context.

    ``grams``: (key, n), distinct keys that hold depth symbols, nearest first, and a byte; n is 0 for grams that only ask.
    """
    cut = min(3, depth)
    root = lambda c: F.shiftright("key", 8 * (depth - c + 1))
    sizes = grams.groupBy(root(cut)).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if sizes["all"] is None:
        return grams.select("key", F.lit(0.0).cast("float").alias("log"))
    if sizes["most"] > wide and depth > cut:
        cut += 1
    tasks = max(1, -(-sizes["all"] // share))
    roots = staged(grams.select("key", "n").repartition(tasks, root(cut)).mapInArrow(_upwards(depth, cut), "context long, node int, n0 long, n1 long, weighted double"))
    above = tops(roots, cut).select((-1 - F.shiftleft("context", 8).bitwiseOR(F.col("node").cast("long"))).alias("key"), F.col("so_far").alias("a"), F.col("left").alias("b"), F.col("p1").alias("c"))
    nothing = F.lit(0.0)
    rows = grams.select("key", F.col("n").cast("double").alias("a"), nothing.alias("b"), nothing.alias("c")).unionByName(above)
    dealt = rows.repartition(tasks, F.when(F.col("key") < 0, F.shiftright(-1 - F.col("key"), 8)).otherwise(root(cut)))
    return dealt.mapInArrow(_downwards(depth, cut), "key long, log float")


def fetched(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of a table of checked size; the table itself is let go."""
    table = df.select(key, value).toArrow()
    keys, values = table[key].to_numpy().view(np.uint64), table[value].to_numpy()
    del table
    pa.default_memory_pool().release_unused()
    return keys, values


class Slice:
    """Grams and words that one scoring pass holds; words are sorted."""

    def __init__(self, depth: int, part: int, parts: int, grams, logs, words, counts, total: int, distinct: int, ends: int):
        self.depth, self.part, self.parts, self.ends = depth, part, parts, ends
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.distinct = total, distinct
        self._index(grams, logs)

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing over the grams."""
        self.bits = max(4, int(len(keys) * 3 // 2).bit_length())
        size = 1 << self.bits
        self.slots, self.logs = np.full(size, np.uint64(2**64 - 1)), np.zeros(size, np.float32)
        # some at a time, so that building takes little more than the table itself
        for begin in range(0, len(keys), 1 << 19):
            todo = np.arange(begin, min(begin + (1 << 19), len(keys)))
            at = self._slot(keys[todo])
            while len(todo):
                free = np.flatnonzero(self.slots[at] == np.uint64(2**64 - 1))
                _, first = np.unique(at[free], return_index=True)
                win = free[first]
                self.slots[at[win]], self.logs[at[win]] = keys[todo[win]], values[todo[win]]
                lost = np.ones(len(todo), bool)
                lost[win] = False
                todo, at = todo[lost], (at[lost] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        found = self.slots[at]
        out = self.logs[at].astype(np.float64)
        todo = np.flatnonzero(found != codes)
        at = at[todo]
        while len(todo):
            # every gram of a text has its place, so the search ends
            at = (at + 1) & (len(self.slots) - 1)
            hit = self.slots[at] == codes[todo]
            out[todo[hit]] = self.logs[at[hit]]
            todo, at = todo[~hit], at[~hit]
        return out

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words) or not len(h):
            return np.zeros(len(h), np.int64)
        distinct, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        return np.where(self.words[at] == distinct, self.counts[at], 0)[back]


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix(values) % np.uint64(parts)).astype(np.int64)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    run = np.concatenate(([0.0], np.cumsum(values)))
    return run[ends] - run[ends - size]


def _score_portion(m: Slice, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(words, known words, base log10, model log10) of each text, as far as the slice holds them."""
    codes, size, words = streams(texts, m.depth)
    n_words = np.array([len(w) for w in words], np.int64)
    h = word_hashes([w for ws in words for w in ws])
    count = m.word_counts(h)
    base = np.log10((count + 1) / (m.total + m.distinct + 1))
    if m.parts > 1:
        logs = np.zeros(len(codes))
        mine = part_of(codes, m.parts) == m.part
        logs[mine] = m.score(codes[mine])
        base[part_of(h, m.parts) != m.part] = 0
    else:
        logs = m.score(codes)
    return n_words, _sums((count > 0).astype(float), n_words), _sums(base, n_words), _sums(logs, size)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Slice = shared.value
        end = math.log10((m.ends + 1) / (m.total + m.distinct + 1))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [_score_portion(m, texts[part]) for part in portions(texts)]
            if not found:
                continue
            n_words, known, base, logs = (np.concatenate([x[k] for x in found]) for k in range(4))
            if m.part == 0:
                known, base = known + (1 if m.ends else 0), base + end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs), batch.column(3)], ["row", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    return run


def _of_part(part: int, parts: int):
    """Rows whose key belongs to a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(part_of(batch.column(0).to_numpy().view(np.uint64), parts) == part))

    return run


def slices(logs: DataFrame, words: DataFrame, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(grams, their logs, words, their counts) of each part: tables of about ``MOST`` rows, whatever the corpus."""
    for part in range(parts):
        own = [df if parts == 1 else df.mapInArrow(_of_part(part, parts), df.schema) for df in (logs, words)]
        yield *fetched(own[0], "key", "log"), *fetched(own[1], "key", "n")


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows where ``held_out`` is not true. ``depth``: 2 to 6 symbols.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.length(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), n_bytes.alias("n_bytes"))
    counts = source.select("text", "held_out").mapInArrow(_count(depth), "kind int, key long, n long")
    counts = staged(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    facts = {x["kind"]: x for x in counts.groupBy("kind").agg(F.count("*").alias("distinct"), F.sum("n").alias("n")).collect()}
    of = lambda k, what: facts[k][what] if k in facts else 0
    ends, words = of(END, "n"), of(WORD, "distinct")
    total, known = of(WORD, "n") + ends, words + (1 if ends else 0)
    grams, word_rows = (counts.where(F.col("kind") == k).select("key", "n") for k in (GRAM, WORD))
    logs = staged(gram_logs(grams, depth))
    parts = max(1, -(-max(of(GRAM, "distinct"), words) // most))
    if parts > 1:
        # every pass scores the same rows, so they are written with a number
        source = staged(source.withColumn("row", F.monotonically_increasing_id()))
    name = "row" if parts > 1 else "doc_id"
    schema = f"row {'long' if parts > 1 else kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    passes = None
    for part, tables in enumerate(slices(logs, word_rows, parts)):
        model = Slice(depth, part, parts, *tables, total, known, ends)
        del tables
        shared = spark.sparkContext.broadcast(model)
        one = source.select(name, "text", "held_out", "n_bytes").mapInArrow(_score(shared), schema)
        if parts > 1:
            one = staged(one)
            shared.destroy()
            # the next slice is fetched after this one is let go
            del model, shared
        passes = one if passes is None else passes.unionByName(one)
    if parts > 1:
        sums = passes.groupBy("row").agg(F.first("held_out").alias("held_out"), F.first("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base_score", "score")), F.first("n_bytes").alias("n_bytes"))
        passes = source.select("doc_id", F.col("row").alias("r")).join(sums.hint("merge"), F.col("r") == F.col("row")).drop("r", "row")
    else:
        passes = passes.withColumnRenamed("row", "doc_id")
    per_byte = -F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))
    return passes.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))
