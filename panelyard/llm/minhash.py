"""Near-duplicate detection: one-permutation hashing with optimal densification.

Every document becomes the set of its word shingles. Equal sets collapse into one
class first, so that copies are never paired. Each class gets one one-permutation
signature (one hash pass, one minimum a bin, empty bins filled by optimal
densification) cut into bands; classes that share a band form a bucket.

Every bucket is resolved with star-shaped edges: each member is compared with one
centre, at first the member that meets most others. What a star leaves open are pairs
of different components in which a member x failed against the centre c. Such a pair
x, y can be linked only if x and y share enough shingles that c lacks, or if what each
shares with c would do. So it is counted first, in arrays, how many of its shingles
outside the centre a member shares with members that it could still be linked with: one
number a member. Members with too few drop out. The others are dealt into blocks, those
that failed apart from the rest, and two blocks meet in one task, unless none in them
failed: what two members have in common follows from what they have beyond c and what
they lack of it, counted as a product of matrices, and is told as one edge a member. So
a group gives no more rows than members times blocks, and only members that failed
multiply the rest.

A group of more than ``WIDE`` blocks goes by lists of rare shared shingles instead (as
many of the rarest as a prefix filter needs): the members of a short list are compared
with each other, a longer list is a group of its own and gets a star with a new centre
among those that failed, until no group is left. No link inside a bucket is lost, no
bucket is capped. Links are confirmed on full sets, or by counts over them.

Defined results: null or word-less text has an empty set, links with nothing and
is kept. Every row stands for itself: rows that share an id are linked only if their
sets are, and a component is named by the smallest id among its rows. A null id is
never linked and is kept. Ids may be of any type that has an order. Extra columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import MULTIPLIER, SECOND, distinct, mix, rolling, signed, staged, word_hashes, words_of

BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: The members of a list of at most so many are compared with each other, those of a longer one with a centre.
SHORT = 128
#: Members of a block, and shingles that two blocks are compared over at a time.
BLOCK, TOKENS = 256, 1 << 14
#: Shingles that set the members of a block apart from the centre, about, and blocks of a group at most.
HELD, WIDE = 1 << 18, 64
#: Shingles outside the centre that one task counts at a time, about.
PART = 1 << 15


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return distinct(rolling(h, min(width, len(h))) ^ np.uint64(min(width, len(h))))


def _probes(first: int, count: int) -> np.ndarray:
    """The bins that an empty bin tries, in order: one row for each bin."""
    i = np.arange(BINS, dtype=np.uint64)[:, None] * MULTIPLIER
    j = np.arange(first, first + count, dtype=np.uint64)[None, :] * SECOND
    return (mix(i + j) % np.uint64(BINS)).astype(np.int32)


_SHORT, _LONG = _probes(0, 24), _probes(24, 1500)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One minimum a bin of sorted hashes; an empty bin copies the first full bin that its own probes reach."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    full = bins[at].astype(np.int64)
    out, known = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[full], known[full] = hashes[at], True
    has = known.copy()
    for table in (_SHORT, _LONG):
        empty = np.flatnonzero(~known)
        if not len(empty):
            break
        hit = has[table[empty]]
        found = hit.any(axis=1)
        source = table[empty, hit.argmax(axis=1)]
        out[empty[found]] = out[source[found]]
        known[empty[found]] = True
    first = 1524
    while not known.all():
        table = _probes(first, 1500)
        empty = np.flatnonzero(~known)
        hit = has[table[empty]]
        found = hit.any(axis=1)
        out[empty[found]] = out[table[empty, hit.argmax(axis=1)][found]]
        known[empty[found]] = True
        first += 1500
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key a band for each row of signatures."""
    s = signatures.reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * SECOND, s.shape[:2])
    for j in range(ROWS):
        h = mix(h * MULTIPLIER + s[:, :, j])
    return h


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            keys = band_keys(np.stack([signature(sets[k]) for k in full])) if len(full) else np.zeros((0, BANDS), np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _names(sets), bands], ["doc_id", "n_shingles", "class", "bands"])

    return run


def _names(sets: list[np.ndarray]) -> pa.Array:
    """A 128-bit digest of each set."""
    return pa.array([xxhash.xxh3_128_digest(s.data) for s in sets], pa.binary())


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([_names(sets), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["rep", "shingles"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of edges (a, b); root: the smallest node reachable.

    Every round links all neighbours of a node, and the node, with the smallest of
    them. It ends when every edge leads from a node with no other edge to a root.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
        seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if seen.where("down > 1 or (down > 0 and up > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        linked = both.join(low.hint("merge"), "a").select(F.col("b").alias("x"), "low").union(low.select("a", "low"))
        edges = staged(linked.where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct())


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) with na, nb and both, the sizes of the two sets and of what they share, and the sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.withColumns({"na": F.size("sa"), "nb": F.size("sb"), "both": F.size(F.array_intersect("sa", "sb"))})


def _meeting(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): edges that connect what is linked, one of the two not with the centre, from two blocks of members; the second is null where a block meets itself."""
    for batch in batches:
        out: list[tuple[list, list]] = []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            one = right.values is None or not len(right.values)
            sides = [left.values] if one else [left.values, right.values]
            names = [x for side in sides for x in side.field("x").to_pylist()]
            n, both, lacks, linked = (np.concatenate([side.field(c).to_numpy(zero_copy_only=False) for side in sides]) for c in ("nx", "both", "lacks", "linked"))
            lists = [side.field("apart") for side in sides]
            k = len(names) if one else len(left.values)
            rows, columns = slice(0, k), slice(0, k) if one else slice(k, None)
            owner = np.repeat(np.arange(len(names)), np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]))
            tokens, place, times = np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]), return_inverse=True, return_counts=True)
            # what one member alone has or lacks is not shared
            several = times > 1
            owner, place = owner[several[place]], (np.cumsum(several) - 1)[place[several[place]]]
            shared = np.zeros((k, len(names[columns])), np.float32)
            for start in range(0, several.sum(), TOKENS):
                use = (place >= start) & (place < start + TOKENS)
                has = np.zeros((len(names), min(TOKENS, several.sum() - start)), np.float32)
                has[owner[use], place[use] - start] = 1
                shared += has[rows] @ has[columns].T
            # of the centre's shingles both have those that neither lacks, and besides what both have beyond it
            common = both[rows, None] - lacks[None, columns] + shared.astype(np.int64)
            near = (100 * common >= percent * (n[rows, None] + n[None, columns] - common)) & ~(linked[rows, None] & linked[None, columns])
            i, j = np.nonzero(near)
            # the smallest name stands for what is connected, so that groups of the same members tell the same edges
            by = np.array(sorted(range(len(names)), key=names.__getitem__))
            at = np.argsort(by)
            low = groups_of(len(names), at[i], at[j if one else j + k])
            moved = np.flatnonzero(low != np.arange(len(names)))
            out.append(([names[m] for m in by[moved]], [names[m] for m in by[low[moved]]]))
        yield pa.RecordBatch.from_arrays([pa.array([x for o in out for x in o[c]], pa.binary()) for c in (0, 1)], ["a", "b"])


def _by_blocks(own: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(a, b) from members of groups (g, x, nx, both, linked, added, lacks) and how they meet (g, x, asked, own and rest: blocks of those asked and of the others): every two blocks meet in a task of their own, unless none in them is asked."""
    block = F.when(F.col("asked"), F.pmod(F.xxhash64("x"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("x"), F.greatest("rest", F.lit(1)))).cast("int")
    meets = F.when(F.col("asked"), F.col("own") + F.col("rest")).otherwise(F.col("own"))
    member = F.struct("x", "nx", "both", F.size("lacks").cast("long").alias("lacks"), "linked", F.concat("added", "lacks").alias("apart")).alias("member")
    dealt = own.join(met.hint("merge"), ["g", "x"]).select("g", block.alias("block"), member, F.explode(F.sequence(F.lit(0), meets - 1)).alias("other"))
    dealt = dealt.select("g", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "member")
    side = lambda c: F.collect_list(F.when(F.col("block") == F.col(c), F.col("member")))
    lists = dealt.groupBy("g", "p", "q").agg(side("p").alias("left"), side("q").alias("right")).where(F.size("left") > 0)
    lists = lists.select("left", F.when(F.col("p") < F.col("q"), F.col("right")).alias("right")).where(F.col("right").isNull() | (F.size("right") > 0))
    return lists.mapInArrow(lambda batches: _meeting(batches, percent), "a binary, b binary").distinct()


_MEMBER = "struct<x: binary, comp: binary, linked: boolean, need: int>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, part, members, who, tokens) from (g, parts, member, added): what the members of a group have beyond its centre, dealt by shingle, one row a batch for each part; ``who``: the places of the shingles' holders in ``members``."""
    for batch in batches:
        g, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "parts"))
        added = batch.column("added")
        tokens = added.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(added.offsets.to_numpy()))
        part = (tokens.view(np.uint64) % parts[owner].astype(np.uint64)).astype(np.int32)
        by = np.lexsort((owner, part, g[owner]))
        tokens, owner, part, group = tokens[by], owner[by], part[by], g[owner[by]]
        start = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])))) if len(by) else by
        ends = np.append(start, len(by)).astype(np.int32)
        # a holder comes once in a part
        new = np.ones(len(by), bool)
        new[1:] = owner[1:] != owner[:-1]
        new[start] = True
        place = np.cumsum(new) - 1
        first = np.append(place[start], new.sum()).astype(np.int32)
        who = place - np.repeat(place[start], np.diff(ends))
        members = pa.ListArray.from_arrays(pa.array(first), batch.column("member").take(pa.array(owner[new])))
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (who.astype(np.int32), tokens)]
        yield pa.RecordBatch.from_arrays([pa.array(group[start]), pa.array(part[start]), members, *lists], ["g", "part", "members", "who", "tokens"])


def _shared(pieces: pa.Scalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(members, who, token, times): shingles of a part that members of different components share, one of them not linked with the centre; ``who``: the holder's place in ``members``."""
    held = pieces.values.field("members")
    sizes = np.diff(held.offsets.to_numpy())
    members = held.flatten()
    lists = pieces.values.field("tokens")
    shift = np.repeat(np.cumsum(sizes) - sizes, np.diff(lists.offsets.to_numpy()))
    who = pieces.values.field("who").flatten().to_numpy(zero_copy_only=False) + shift
    tokens, place, times = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    comp = members.field("comp").dictionary_encode().indices.to_numpy(zero_copy_only=False)[who]
    failed = np.zeros(len(tokens), bool)
    failed[place[~members.field("linked").to_numpy(zero_copy_only=False)[who]]] = True
    low, high = np.full(len(tokens), len(members)), np.full(len(tokens), -1)
    np.minimum.at(low, place, comp)
    np.maximum.at(high, place, comp)
    use = (failed & (low < high))[place]
    return members, who[use], tokens[place[use]], times[place[use]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x, comp, linked, need, have): how many such shingles of a part a member has."""
    for batch in batches:
        for g, pieces in zip(batch.column("g").to_pylist(), batch.column("pieces"), strict=True):
            members, who, _, _ = _shared(pieces)
            have = np.bincount(who, minlength=len(members))
            some = np.flatnonzero(have)
            kept = members.take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), g)), *(kept.field(c) for c in ("x", "comp", "linked", "need")), pa.array(have[some])],
                ["g", "x", "comp", "linked", "need", "have"],
            )


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x, comp, linked, need, token, times): a row for each such shingle of a member."""
    for batch in batches:
        for g, pieces in zip(batch.column("g").to_pylist(), batch.column("pieces"), strict=True):
            members, who, tokens, times = _shared(pieces)
            kept = members.take(pa.array(who))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(who), g)), *(kept.field(c) for c in ("x", "comp", "linked", "need")), pa.array(tokens), pa.array(times)],
                ["g", "x", "comp", "linked", "need", "token", "times"],
            )


def groups_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over edges (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        low = low[low]
        if np.array_equal(low, before):
            return low


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, comp) after links (a, b) between reps."""
    ends = [label.select(F.col("rep").alias(k), F.col("comp").alias(f"c{k}")).hint("merge") for k in "ab"]
    roots = connected(links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return staged(label.join(roots.select(F.col("node").alias("comp"), "root").hint("merge"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp")))


def _first_groups(members: DataFrame) -> DataFrame:
    """(g, x, order) from (bucket, rep): the member that meets most others comes first; buckets with the same first one are one group."""
    sizes = members.groupBy("bucket").agg((F.count("*") - 1).alias("others"))
    degree = members.join(sizes.hint("merge"), "bucket").groupBy("rep").agg(F.sum("others").alias("degree"))
    ranked = staged(members.join(degree.hint("merge"), "rep"))
    centres = ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("degree"), "rep")).alias("m")).select("bucket", F.xxhash64("m.rep").alias("g"))
    return ranked.join(centres.hint("merge"), "bucket").select("g", F.col("rep").alias("x"), (-F.col("degree")).alias("order")).distinct()


def _stars(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(g, x, c, nx, both, linked, added, lacks): every member against the centre of its group; ``added``: what x has beyond c, ``lacks``: what it lacks of c."""
    groups = staged(groups)
    facts = groups.groupBy("g").agg(F.min(F.struct("order", "x")).alias("m"), F.count("*").alias("n")).select("g", F.col("m.x").alias("c"), "n")
    rays = staged(groups.join(facts.hint("merge"), "g").where("x <> c").select("g", "x", "c", "n"))
    pairs = rays.groupBy(F.col("x").alias("a"), F.col("c").alias("b")).agg(F.max("n").alias("n"))
    found = _compared(pairs, sets)
    linked = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    # without a third member nothing can be left open
    added, lacks = (F.when(F.col("n") > 2, F.array_except(*x)) for x in (("sa", "sb"), ("sb", "sa")))
    found = found.select(F.col("a").alias("x"), F.col("b").alias("c"), F.col("na").alias("nx"), "both", linked.alias("linked"), added.alias("added"), lacks.alias("lacks"))
    return staged(rays.drop("n").join(found.hint("merge"), ["x", "c"]))


def _several() -> list[Column]:
    """Open is what has ``failed > 0 and low <> high``: members of different components, one of which failed."""
    return [F.count_if(~F.col("linked")).alias("failed"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")]


def _left_open(stars: DataFrame, label: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (a, b), edges (a, b), groups (g, x, order)): what may be, and what is linked although one of the two is not linked with the centre, and lies in another component."""
    # a linked pair shares at least percent % of the larger set; without a shared addition x and y share at most what x shares with c, so y must be small
    least = F.ceil(F.col("nx") * percent / 100)
    room = F.floor((100 + percent) * F.col("both") / percent - F.col("nx"))
    known = stars.where("added is not null").join(label.select(F.col("rep").alias("x"), "comp").hint("merge"), "x").withColumn("tight", ~F.col("linked") & (least <= room))
    parts = F.greatest(F.ceil(F.sum(F.size("added")) / PART), F.lit(1)).cast("int").alias("parts")
    open_ = known.groupBy("g").agg(*_several(), parts, F.max("tight").alias("whole")).where("failed > 0 and low <> high").select("g", "parts", "whole")
    own = staged(known.join(open_.hint("merge"), "g"))
    # shingles stay in arrays: what an open pair shares, members of two components share, one of which failed
    need = F.greatest(least - F.col("both"), F.lit(1)).cast("int").alias("need")
    few = _pieces(own, need).mapInArrow(_counted, "g long, x binary, comp binary, linked boolean, need int, have long")
    few = few.groupBy("g", "x").agg(*(F.first(c).alias(c) for c in ("comp", "linked", "need")), F.sum("have").alias("have"))
    kept = staged(few.where("have >= need").select(F.col("g").alias("list"), "x", "comp", "linked"))
    able = own.select("g", "x", "linked", "tight", "whole", (F.size("added") + F.size("lacks")).alias("held")).join(kept.select(F.col("list").alias("g"), "x", F.lit(True).alias("able")).hint("merge"), ["g", "x"], "left")
    able = able.where("able or whole").withColumn("asked", ~F.col("linked") & (F.coalesce("able", F.lit(False)) | F.col("tight")))
    blocks = lambda of: F.ceil(F.greatest(F.count_if(of) / BLOCK, F.sum(F.when(of, F.col("held"))) / HELD)).cast("int")
    sizes = able.groupBy("g").agg(blocks(F.col("asked")).alias("own"), blocks(~F.col("asked")).alias("rest")).where("own > 0")
    met = staged(able.join(sizes.hint("merge"), "g").select("g", "x", "asked", "own", "rest", (~F.col("whole") & (F.col("own") + F.col("rest") > WIDE)).alias("wide")))
    edges = _by_blocks(own, met.where("not wide").drop("wide"), percent)
    wide = met.where("wide").select("g").distinct()
    if wide.isEmpty():
        pairs, groups = (own.sparkSession.createDataFrame([], kind) for kind in ("a binary, b binary", "g long, x binary, order long"))
        return pairs, edges, groups
    pairs, groups = _by_lists(own.join(wide.hint("merge"), "g", "left_semi"), need)
    return pairs, edges, groups


def _pieces(own: DataFrame, need: Column) -> DataFrame:
    """(g, part, pieces): what the members of groups have beyond the centre, dealt by shingle."""
    dealt = own.select("g", "parts", F.struct("x", "comp", "linked", need).alias("member"), "added").mapInArrow(_parts, f"g long, part int, members array<{_MEMBER}>, who array<int>, tokens array<long>")
    return dealt.groupBy("g", "part").agg(F.collect_list(F.struct("members", "who", "tokens")).alias("pieces"))


def _by_lists(own: DataFrame, need: Column) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), groups (g, x, order)) of groups in which no member is linked without a shared addition, by lists of rare shared shingles."""
    shared = _pieces(own, need).mapInArrow(_common, "g long, x binary, comp binary, linked boolean, need int, token long, times long")
    line = Window.partitionBy("g", "x")
    kept = shared.withColumns({"place": F.row_number().over(line.orderBy("times", "token")), "have": F.count("*").over(line)}).where("place <= have - need + 1")
    kept = staged(kept.select(F.xxhash64("g", "token").alias("list"), "x", "comp", "linked"))
    # shingles of one changed place have the same members: one list stands for all lists of equal members
    same = [F.bit_xor(F.xxhash64(F.lit(k), "x", "linked")).alias(f"same{k}") for k in (1, 2)]
    lists = kept.groupBy("list").agg(*_several(), *same).where("failed > 0 and low <> high").groupBy("n", "same1", "same2").agg(F.min("list").alias("list"))
    kept = staged(kept.join(lists.select("list", "n").hint("merge"), "list"))
    short = kept.where(F.col("n") <= SHORT)
    left, right = short.where("not linked").select("list", "x", "comp"), short.select("list", F.col("x").alias("y"), F.col("comp").alias("other"), F.col("linked").alias("joined"))
    # of two that failed each meets the other once
    by_token = left.join(right.hint("merge"), "list").where("comp <> other and (joined or x < y)").select("x", "y")
    groups = kept.where(F.col("n") > SHORT).select(F.col("list").alias("g"), "x", F.col("linked").cast("long").alias("order"))
    return by_token.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), groups


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``percent``: two documents are linked if 100 * intersection >= percent * union
    of their sets of ``width``-word shingles.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    described = staged(source.mapInArrow(_describe(width), f"doc_id {kind}, n_shingles long, class binary, bands array<long>"))
    linkable = described.where("n_shingles > 0 and doc_id is not null")
    classes = staged(linkable.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    spread = classes.select(F.col("class").alias("rep"), F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = staged(spread.join(shared.hint("merge"), "bucket", "left_semi"))
    wanted = staged(members.select("rep").distinct())
    holders = classes.join(wanted.hint("merge"), F.col("class") == F.col("rep"), "left_semi").select("doc_id").distinct()
    # an id may have several texts: each is a set of its own
    sets = staged(source.join(holders.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(width), "rep binary, shingles array<long>").dropDuplicates(["rep"]))
    label = wanted.select("rep", F.col("rep").alias("comp"))
    groups = _first_groups(members)
    while True:
        stars = _stars(groups, sets, percent)
        label = _joined(label, stars.where("linked").select(F.col("x").alias("a"), F.col("c").alias("b")))
        pairs, edges, groups = _left_open(stars, label, percent)
        pairs, edges = staged(pairs), staged(edges)
        if not pairs.isEmpty() or not edges.isEmpty():
            found = _compared(pairs, sets).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
            label = _joined(label, staged(found.unionByName(edges)))
        if groups.isEmpty():
            break
    # classes of one component: the smallest id stands for all
    named = staged(classes.select("class", "doc_id").join(label.select(F.col("rep").alias("class"), "comp").hint("merge"), "class", "left").select("class", "doc_id", F.coalesce("comp", "class").alias("comp")))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least"))
    of_class = named.join(least.hint("merge"), "comp").select("class", "least")
    out = described.drop("bands").join(of_class.hint("merge"), "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("least")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
