"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 3 bits share at least
5 of them, each at its own position: the guaranteed minimum of matches. Equal fingerprints
are one entry, so copies are never paired.

The index lists fingerprints by the bytes at several positions. A pair that reaches the
minimum is in the list of its first k shared positions for every k up to 5, and at most 3
positions are passed over before them, so 10 lists an entry do for k = 2. In a list of up
to ``LIST`` members the shared positional bytes of every pair are tallied, pairs with 5 or
more are retained, and those are verified bit by bit. A longer list is not paired: each
member goes on to the lists of one more position, where the tally of all its pairs is one
higher. Lists of 5 positions that are still longer are dealt into pairs of blocks; beyond
``BLOCKS`` blocks every member instead names what remains of its last 24 bits when 3 are
masked, and members with a name in common are linked, which is linear in the list. So no
list is capped and no link is lost.

What a list yields is not its links but its connected groups, one edge a member, so a
dense family gives as many edges as it has members.

Defined results: null text is empty; without words the fingerprint is 0 and is linked like
any other. Every row stands for itself; rows that share an id keep their own fingerprints.
A null id is never linked and its component is null. Ids may be of any type that has an
order. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.minhash import connected, groups_of
from panelyard.llm.shared import signed, staged

BYTES, DISTANCE = 8, 3
LEAST = BYTES - DISTANCE
#: Lists of at most so many members are tallied at once; longer ones get another position, or blocks of so many.
LIST = 1024
#: From so many blocks on, masked names are fewer than comparisons.
BLOCKS = 128
SEED = 42
#: Shingles hashed at a time.
CHUNK = 1 << 16

LOW, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64 majorities over the XXH64 of all word shingles, repeats included; A-Z lower-cased."""
    words = text.lower().split() if text else []
    n = max(len(words) - width + 1, 1) if words else 0
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : min(start + CHUNK, n) + width - 1]
        runs = map(b" ".join, zip(*(part[j:] for j in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(prints))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint of each document as a signed number."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_describe(width), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, print long")


def position_sets(k: int) -> list[tuple[int, ...]]:
    """The sets of k positions that can be the first k shared ones: at most 3 are passed over."""
    return [s for s in combinations(range(BYTES), k) if s[-1] < k + DISTANCE]


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of some bytes, as a signed number."""
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def shared_bytes(differ: np.ndarray) -> np.ndarray:
    """How many bytes of each number are zero: the tally of shared positional bytes, from the bits that differ."""
    return np.bitwise_count(~(((differ & LOW) + LOW) | differ) & HIGH)


def linked_pairs(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] and b[j] at most ``distance`` bits apart: tally, retain, verify."""
    differ = a[:, None] ^ b[None, :]
    i, j = np.nonzero(shared_bytes(differ) >= BYTES - distance)
    near = np.bitwise_count(differ[i, j]) <= distance
    return i[near], j[near]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) in one group, from pairs of member lists; the second is null where a list meets itself."""
    for batch in batches:
        a, b = [], []
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            x = left.values.to_numpy(zero_copy_only=False)
            y = right.values.to_numpy(zero_copy_only=False) if right.is_valid else None
            both = x if y is None else np.concatenate((x, y))
            i, j = linked_pairs(x.view(np.uint64), (x if y is None else y).view(np.uint64))
            low = groups_of(len(both), i, j if y is None else j + len(x))
            moved = np.flatnonzero(low != np.arange(len(both)))
            a.append(both[moved])
            b.append(both[low[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (a, b)], ["a", "b"])


def _listed(members: DataFrame, k: int) -> DataFrame:
    """(set, key, print, n): every member with the length of its list; lists of one are left out. Written."""
    sets = position_sets(k)
    masks = F.array(*(F.lit(_mask(s)).cast("long") for s in sets))
    own = members.select("set", "print", F.col("print").bitwiseAND(F.get(masks, F.col("set"))).alias("key"))
    sizes = own.groupBy("set", "key").agg(F.count("*").alias("n")).where("n > 1")
    return staged(own.join(sizes.hint("merge"), ["set", "key"]))


def _next(members: DataFrame, k: int) -> DataFrame:
    """(set, print) with one more position behind those of each set, from sets of k positions."""
    longer = {s: p for p, s in enumerate(position_sets(k + 1))}
    after = [[longer[t] for t in ((*s, q) for q in range(s[-1] + 1, BYTES)) if t in longer] for s in position_sets(k)]
    table = F.array(*(F.array(*map(F.lit, a)) for a in after))
    return members.select(F.explode(F.get(table, F.col("set"))).alias("set"), "print")


def _self_edges(short: DataFrame) -> DataFrame:
    """Edges inside lists of at most ``LIST`` members."""
    lists = short.groupBy("set", "key").agg(F.collect_list("print").alias("x"))
    return lists.select("x", F.lit(None).cast("array<long>").alias("y")).mapInArrow(_edges, "a long, b long")


def _block_edges(long_: DataFrame, most: int) -> DataFrame:
    """Edges inside longer lists: every pair of blocks meets in a group of its own."""
    dealt = long_.withColumn("blocks", F.ceil(2 * F.col("n") / most).cast("int")).withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    # block p meets block q in group (least, greatest); with itself in (p, p)
    met = dealt.select("set", "key", "print", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("set", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "print")
    side = lambda c: F.collect_list(F.when(F.col("block") == F.col(c), F.col("print")))
    lists = met.groupBy("set", "key", "p", "q").agg(side("p").alias("x"), side("q").alias("y"))
    return lists.select("x", F.when(F.col("p") < F.col("q"), F.col("y")).alias("y")).mapInArrow(_edges, "a long, b long")


def _masked_edges(huge: DataFrame) -> DataFrame:
    """Edges inside the longest lists of ``LEAST`` positions: members that agree but for 3 of the last 24 bits."""
    bits = [[8 * p + o for p in range(BYTES) if p not in s for o in range(8)] for s in position_sets(LEAST)]
    # the c-th choice of 3 out of 24 places, and where those places lie for each set
    places = F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(8 * DISTANCE), DISTANCE)))
    table = F.array(*(F.array(*(F.lit(1 << x if x < 63 else -(1 << 63)).cast("long") for x in b)) for b in bits))
    each = huge.select("set", "key", "print", F.get(table, F.col("set")).alias("own"), F.explode(places).alias("c"))
    hidden = F.aggregate("c", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.get("own", x)))
    named = each.select("set", "key", "print", hidden.alias("hidden")).select("set", "hidden", F.col("print").bitwiseOR(F.col("hidden")).alias("name"), "print")
    least = named.groupBy("set", "hidden", "name").agg(F.min("print").alias("b"), F.max("print").alias("a")).where("a <> b")
    # names have at most 8 members: what lies between is named by other masks or joined here
    joined = named.join(least.select("set", "hidden", "name", "b").hint("merge"), ["set", "hidden", "name"])
    return joined.where("print <> b").select(F.col("print").alias("a"), "b")


def edges(prints: DataFrame, most: int = LIST, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (print) that are linked directly or over others."""
    k = 2
    members = prints.select(F.explode(F.array(*map(F.lit, range(len(position_sets(k)))))).alias("set"), "print")
    found = None
    while True:
        listed = _listed(members, k)
        parts = [_self_edges(listed.where(F.col("n") <= most))]
        if k == LEAST:
            huge = F.col("n") > blocks * most
            parts += [_block_edges(listed.where((F.col("n") > most) & ~huge), most), _masked_edges(listed.where(huge))]
        for part in parts:
            found = part if found is None else found.unionByName(part)
        rest = listed.where(F.col("n") > most)
        if k == LEAST or rest.isEmpty():
            return found
        members, k = _next(rest, k), k + 1


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    described = staged(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    prints = staged(described.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = connected(edges(prints.select("print")))
    placed = staged(prints.join(roots.select(F.col("node").alias("print"), "root").hint("merge"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = staged(placed.join(least.hint("merge"), "root").select("print", "component_id"))
    out = described.join(component.hint("merge"), "print", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
