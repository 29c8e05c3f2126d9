"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (its lines; a line of over ``LONG_LINE`` characters is cut at
the first sentence end after each ``PIECE`` characters) become 64-bit digests; a repeated paragraph gets a digest for
each occurrence. The sketch has 2^b blocks of ``CELLS`` cells. A digest belongs to
one block and to one cell in each third of it; a cell keeps a count, the xor of its
digests and the xor of their checks. b follows from the number of digests, so equal
texts have equal sketches.

To compare, the two fingerprints subtract cell by cell, the one with more blocks
folded to as many as the other has (block i and block i + 2^b add up). Then blocks
peel: a cell with count 1 or -1 and a fitting check holds one differing digest, which
is taken out of its other cells, until nothing is left. Where that gets stuck, both
texts get larger sketches: as many blocks as the larger text wants, then four times as
many, up to ``TRIES`` times; what is stuck even then is read off the digests
themselves. likeness = shared digests / all digests.

Everything is array functions of columns; blocks stay small, so the work grows
with the number of paragraphs only, and rows meet only their successor.

Defined results: null and empty texts have one empty paragraph, so two of them have
likeness 1. Documents follow one another by (doc_id, a hash of the text, text), null
ids last, repeated rows one after the other; the last is followed by the first. Ids
are of any type that has an order and a text form. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.shared import staged

THIRD = 8
CELLS = 3 * THIRD
#: Digests of one text that a block holds on average, at most.
LOAD = 3
TRIES = 2
ROUNDS = 10
#: A piece of 100 characters and more: of texts that keep three quarters of their length, 3 in 100 share no piece, 8 in 100 with pieces of 500.
LONG_LINE, PIECE = 200, 100
#: Ranges of ids are found by two looks of this many bounds; a range has about so many characters.
FAN, RANGE_CHARS = 256, 64_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """Sorted digests; further occurrences of a paragraph count apart."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > LONG_LINE, F.regexp_extract_all(x, F.lit(rf".{{{PIECE},}}?[.!?](?: |$)|.+"), F.lit(0))).otherwise(F.array(x))))
    hashed = F.array_sort(F.transform(parts, lambda x: F.xxhash64(x)))
    numbered = let(hashed, lambda a: F.transform(a, lambda x, i: F.when((i > 0) & (x == F.get(a, i - 1)), F.xxhash64(x, i - F.array_position(a, x))).otherwise(x)))
    return F.array_sort(numbered)


def bits_of(n: Column) -> Column:
    """How many bits number the blocks of a sketch of ``n`` digests."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(LOAD))))).cast("int")


def check_of(d: Column) -> Column:
    return F.xxhash64(d, F.lit(7))


def _entry(d: Column, n: Column) -> Column:
    """A digest with its check and its place in each third, worked out once."""
    place = lambda k: F.shiftrightunsigned(d, 40 + 5 * k).bitwiseAND(F.lit(THIRD - 1)).cast("int")
    return F.struct(n.cast("int").alias("n"), d.alias("key"), check_of(d).alias("check"), *(place(k).alias(f"p{k}") for k in range(3)))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def blocks(d: Column, bits: Column) -> Column:
    """The digests by block, split in two steps so that no digest meets all blocks."""

    def split(at: Column) -> Column:
        part = lambda hi: F.filter(d, lambda x: F.call_function("shiftright", x, at["half"]).bitwiseAND(at["high"]) == hi)
        inner = lambda own: F.transform(F.sequence(F.lit(0).cast("long"), at["low"]), lambda lo: F.filter(own, lambda x: x.bitwiseAND(at["low"]) == lo))
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), at["high"]), lambda hi: let(part(hi), inner)))

    half = F.floor(bits / 2).cast("int")
    mask = lambda k: (F.pow(F.lit(2.0), k).cast("long") - 1)
    return let(F.struct(half.alias("half"), mask(half).alias("low"), mask(bits - half).alias("high")), split)


def sketch(d: Column, bits: Column) -> Column:
    """array<block>; block: array of ``CELLS`` (n, key, check)."""
    add = lambda a, x: _cell(a["n"] + 1, a["key"].bitwiseXOR(x["key"]), a["check"].bitwiseXOR(x["check"]))
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def third(own: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(THIRD - 1)), lambda j: F.aggregate(F.filter(own, lambda x: x[f"p{k}"] == j), zero, add))

    def cells(own: Column) -> Column:
        return F.concat(*(third(own, k) for k in range(3)))

    entries = lambda own: F.transform(own, lambda x: _entry(x, F.lit(1)))
    return let(bits, lambda b: let(d, lambda v: F.transform(blocks(v, b), lambda own: let(entries(own), cells))))


def as_text(cells: Column) -> Column:
    """The sketch as a string: hexadecimal cells, empty ones as a dash."""
    cell = lambda c: F.when(c["n"] == 0, "-").otherwise(F.concat_ws(".", F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(c["check"])))
    return F.concat_ws("/", F.transform(cells, lambda b: F.concat_ws(",", F.transform(b, cell))))


def _empty(c: Column) -> Column:
    return (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)


def peel(block: Column) -> Column:
    """(left, found): whether anything is left in a subtracted block, and how many digests came out."""

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == check_of(c["key"])))
        pure = F.array_distinct(F.transform(alone, lambda c: _entry(c["key"], c["n"])))

        def take(keys: Column) -> Column:
            minus = lambda a, x: _cell(a["n"] - x["n"], a["key"].bitwiseXOR(x["key"]), a["check"].bitwiseXOR(x["check"]))

            def third(k: int) -> Column:
                old = F.slice(state["cells"], k * THIRD + 1, THIRD)
                return F.transform(old, lambda c, j: F.when(_empty(c), c).otherwise(F.aggregate(F.filter(keys, lambda x: x[f"p{k}"] == j), c, minus)))

            return F.struct(F.concat(third(0), third(1), third(2)).alias("cells"), (state["found"] + F.size(keys)).alias("found"), F.lit(True).alias("go"))

        stay = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("go"))
        return F.when(~state["go"], state).otherwise(let(pure, lambda keys: F.when(F.size(keys) == 0, stay).otherwise(take(keys))))

    begin = F.struct(block.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("go"))
    ran = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.struct(F.exists(s["cells"], lambda c: ~_empty(c)).alias("left"), s["found"].alias("found")))
    return F.when(F.exists(block, lambda c: ~_empty(c)), ran).otherwise(F.struct(F.lit(False).alias("left"), F.lit(0).alias("found")))


def differing(a: Column, b: Column) -> Column:
    """How many digests two sketches of equal shape differ by; null where peeling gets stuck."""
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: _cell(p["n"] - q["n"], p["key"].bitwiseXOR(q["key"]), p["check"].bitwiseXOR(q["check"])))
    peeled = F.zip_with(a, b, lambda x, y: let(minus(x, y), peel))
    return let(peeled, lambda p: F.when(~F.exists(p, lambda x: x["left"]), F.aggregate(p, F.lit(0), lambda s, x: s + x["found"])))


def folded(cells: Column, size: Column) -> Column:
    """A sketch with as many blocks as ``size``, a part of its own by a power of two."""
    plus = lambda x, y: F.zip_with(x, y, lambda p, q: _cell(p["n"] + q["n"], p["key"].bitwiseXOR(q["key"]), p["check"].bitwiseXOR(q["check"])))

    def fold(s: Column) -> Column:
        rest = lambda i: F.sequence(i + size, F.size(s) - 1, size)
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(rest(i), F.get(s, i), lambda acc, j: plus(acc, F.get(s, j))))

    return F.when(F.size(cells) <= size, cells).otherwise(let(cells, fold))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Shared digests / all digests of two texts, from their sketches; the digests a, b serve for larger sketches where peeling gets stuck."""

    def grown(times: int) -> Column:
        bits = F.greatest(bits_of(F.size(a)), bits_of(F.size(b))) + 2 * times
        return let(bits, lambda n: differing(sketch(a, n), sketch(b, n)))

    size = F.least(F.size(sketch_a), F.size(sketch_b))
    both = let(size, lambda n: differing(folded(sketch_a, n), folded(sketch_b, n)))
    # of equal size: that was the sketch the larger text wants
    wanted = F.when(F.size(sketch_a) != F.size(sketch_b), grown(0))
    # peeling sees a digest once from either side, so the rest is shared
    plain = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    found = F.coalesce(both, wanted, *(grown(t) for t in range(1, TRIES + 1)), plain)
    total = F.size(a) + F.size(b)
    return F.when(sketch_a == sketch_b, F.lit(1.0)).otherwise(let(found, lambda d: (total - d) / (total + d)))


def id_bounds(texts: DataFrame, ranges: int) -> list:
    """Ids that cut the table into about equal parts; one that fills several parts comes several times."""
    steps = [k / ranges for k in range(1, ranges)]
    if not steps:
        return []
    if isinstance(texts.schema["doc_id"].dataType, T.NumericType):
        return sorted(texts.agg(F.percentile_approx("doc_id", steps)).first()[0] or [])
    # other types have no percentiles: cut a bounded sample; only how even the ranges are rests on it
    known = texts.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "h").alias("r"))
    sample = sorted(x[0] for x in known.orderBy("r").limit(16 * min(ranges, 4096)).select("doc_id").collect())
    return [sample[int(q * len(sample))] for q in steps] if sample else []


def in_ranges(texts: DataFrame, ranges: int) -> DataFrame:
    """``texts`` with ``range``, a (place, part) that rises with (doc_id, h), null ids last; ids that fill several ranges, and null ids, are split by h."""
    facts = texts.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    bounds = Counter(id_bounds(texts, ranges))
    kind, at = texts.schema["doc_id"].dataType, F.col("doc_id")
    values = sorted(bounds)
    # literals as one string each: an expression for each of 65,536 bounds would be too large
    listed = lambda part: F.transform(F.split(F.lit(part), ","), lambda x: F.decode(F.unhex(x), "UTF-8").cast(kind))
    coded = lambda part: ",".join(str(x).encode().hex() for x in part)
    numbers = lambda part: F.split(F.lit(part), ",").cast("array<int>")
    below = lambda found: F.size(F.filter(found, lambda b: b <= at))
    part_of = lambda n: F.floor((F.shiftright(F.col("h"), 1) / F.lit(float(1 << 63)) + 0.5) * n).cast("int")
    place, part = F.lit(0), F.lit(0)
    if values:
        groups = [values[k : k + FAN] for k in range(0, len(values), FAN)]
        outer = below(listed(coded(g[0] for g in groups))) - 1
        inner = F.get(F.split(F.lit(";".join(map(coded, groups))), ";"), F.col("_outer"))
        inside = F.transform(F.split(inner, ","), lambda x: F.decode(F.unhex(x), "UTF-8").cast(kind))
        texts = texts.withColumn("_outer", outer)
        place = F.when(F.col("_outer") < 0, 0).otherwise(F.col("_outer") * FAN + below(inside))
        heavy = [k for k, v in enumerate(values, 1) if bounds[v] > 1]
        if heavy:
            which = F.array_position(numbers(",".join(map(str, heavy))), F.col("_place")).cast("int")
            times = F.get(numbers(",".join(str(bounds[values[k - 1]]) for k in heavy)), which - 1)
            own = F.get(listed(coded(values[k - 1] for k in heavy)), which - 1)
            part = F.when(which == 0, 0).when(at == own, part_of(times)).otherwise(times)
    nulls = max(1, -(-facts["none"] * ranges // max(facts["n"], 1)))
    placed = texts.withColumn("_place", F.when(at.isNull(), len(values) + 1).otherwise(place))
    return placed.withColumn("range", F.struct(F.col("_place").cast("int").alias("place"), F.when(at.isNull(), part_of(F.lit(nulls))).otherwise(part).cast("int").alias("part"))).drop("_place", "_outer")


def with_next(texts: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, h, d and the next document's text and digests as next_text, next_d.

    Ids are dealt into ranges of about equal counts. Each range also gets the first
    document of the next range, so that one sort within ranges finds all successors.
    """
    placed = in_ranges(texts, ranges)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    order = Window.orderBy("range")
    firsts = placed.groupBy("range").agg(F.min(key).alias("first"))
    # one row for each range
    following = F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = staged(firsts.select(F.col("range").alias("before"), following.alias("key")).select("before", F.col("key.doc_id").alias("f_id"), F.col("key.h").alias("f_h")))
    # at most one row for each range, which the caller chose; equal rows are as good as each other
    met = placed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")))
    guests = met.select(*texts.columns, F.col("before").alias("range")).dropDuplicates(["range", "h"])
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    line = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "h", "text")
    led = both.withColumns({"next_text": F.lead("text").over(line), "next_d": F.lead("d").over(line)})
    return led.where("guest = 0").drop("range", "guest", "h")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the first characters of the next document instead of its own last quarter.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    if ranges is None:
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        ranges = min(FAN * FAN, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS))
    led = with_next(texts.withColumn("d", digests(F.col("text"))), ranges)
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    cut = led.select("doc_id", F.col("d").alias("d"), "next_d", size.cast("long").alias("n_chars"), edited.alias("edited"))
    made = cut.select("doc_id", "n_chars", "d", "next_d", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_d"))
    own = lambda c: sketch(F.col(c), bits_of(F.size(c)))
    made = made.select("*", own("d").alias("s"), own("edited_d").alias("edited_s"), own("next_d").alias("next_s"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("edited_s")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("edited_d"), F.col("s"), F.col("edited_s")).alias("near_edited"),
        likeness(F.col("d"), F.col("next_d"), F.col("s"), F.col("next_s")).alias("near_next"),
    )
