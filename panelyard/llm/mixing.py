"""Mixing sources to target weights by Pareto order sampling.

Targets come from the weights of the sources, stop at ``most`` times what a source
has, and hand the excess on by weight. A source whose target is f times its size
takes floor(f) whole copies of every document; the remaining share r = f - floor(f)
is a sample of a fixed number of documents with unequal inclusion odds.

The sample is drawn within size classes of the source (four to each power of two),
so that a fixed number of documents brings words near r times those of the class.
From the largest class on, a class draws the whole number of documents that comes
nearest to its share and to what larger classes left over. Inclusion probabilities
in a class are proportional to size and add up to that number, p = c * size; where
c * size reaches 1 a document is certain, and c is worked out anew for the rest.
Certain documents are taken. The others get the rank variable
(u / (1 - u)) / (p / (1 - p)), with u a hash of the id, and as many as are still to be
drawn, those of lowest rank, are taken.

The cut is found without sorting a class: ranks are counted in bins, the bin that
holds the cut is counted in finer bins, and only one fine bin is ordered.

Defined results: null text has size 0; a null source is a source of its own, last
in order; a null id hashes as null, and equal rows are told apart only by order, so
reruns agree. Documents without words are taken 0 times, and so are sources without.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Sources and their size classes are joined by broadcast up to this number of them.
MOST_BROADCAST = 50_000
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight: Column, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); ``weight`` may use ``place``, 0 for the first.

    The level at which capped targets add up to the total is found in closed form:
    with sources by size / weight, the first k are full and the rest share by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    placed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = placed.withColumn("level", level)
    # the level of the first source that its cap does not reach holds for all later ones
    open_ = F.col("level") * F.col("weight") <= most * F.col("source_size")
    lasting = F.min(F.when(open_, F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(whole)["level"]
    return levels.select("source", "source_size", F.least(most * F.col("source_size"), F.coalesce(lasting, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _by_source(left: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Join a table of sources: broadcast if few, else by shuffle, where a hot source is split."""
    return left.join(sources.hint("broadcast" if few else "merge"), left["source"].eqNullSafe(sources["source"])).drop(sources["source"])


def class_of(size: Column) -> Column:
    """Four classes to each power of two: the number of bits, and the two bits after the first."""
    bits = F.length(F.bin(size))
    return bits * 4 + F.when(bits > 2, F.call_function("shiftright", size, bits - 3).cast("int").bitwiseAND(F.lit(3))).otherwise(0)


def drawn(classes: DataFrame) -> DataFrame:
    """(source, class, m): how many documents of a class are drawn, from (source, rest, class, n, words)."""
    state = lambda left, out: F.struct(left.alias("left"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        mean = x["words"].cast("double") / x["n"].cast("double")
        want = s["left"] + x["rest"] * x["words"].cast("double")
        m = F.least(F.greatest(F.floor(want / mean + 0.5), F.lit(0)), x["n"])
        return state(want - m.cast("double") * mean, F.concat(s["out"], F.array(F.struct(x["class"].alias("class"), m.alias("m")))))

    # a source has at most four classes for each bit of a size
    own = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "n", "words", "rest")), asc=False).alias("own"))
    none = F.array().cast("array<struct<class: int, m: bigint>>")
    return own.select("source", F.explode(F.aggregate("own", state(F.lit(0.0), none), step, lambda s: s["out"])).alias("x")).select("source", "x.class", "x.m")


def chances(sized: DataFrame, most: float, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, whole, rest) and (source, class, factor, draws): ``factor`` times a size is its inclusion probability, ``draws`` documents are drawn beside the certain ones."""
    by_size = staged(sized.groupBy("source", "class", "size").agg(F.count("*").alias("n")))
    words = F.col("size") * F.col("n")
    goal = targets(by_size.groupBy("source").agg(F.sum(words).alias("source_size")), weight, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = staged(goal.withColumn("whole", F.floor(times)).withColumn("rest", times - F.col("whole")))
    shared = _by_source(by_size.where("size > 0"), plan.select("source", "rest"), False).where("rest > 0")
    classes = drawn(shared.groupBy("source", "rest", "class").agg(F.sum("n").alias("n"), F.sum(words).alias("words")))
    # sizes of a class from the largest on: the first of them whose probability stays below 1 gives the factor
    line = Window.partitionBy("source", "class").orderBy(F.col("size").desc())
    above = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(words).over(line.rowsBetween(0, Window.unboundedFollowing))
    level = _by_class(by_size.where("size > 0"), classes, False).where("m is not null")
    level = level.withColumn("draws", F.col("m") - above).withColumn("factor", F.col("draws").cast("double") / below.cast("double"))
    first = level.where(F.col("factor") * F.col("size") < 1).groupBy("source", "class").agg(F.max(F.struct("size", "factor", "draws")).alias("f"))
    return plan, staged(first.select("source", "class", "f.factor", "f.draws"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, most: float = 3.0, seed: int = 11, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, chance (of one copy beyond the whole ones).

    ``weight``: weight of a source by its ``place`` in code point order, default 1, 2, 3, repeating.
    ``most_broadcast``: up to so many classes of sources are joined by broadcast, more by shuffle.
    """
    weight = F.col("place") % 3 + 1 if weight is None else weight
    size = word_count(F.col(text_col))
    sized = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), class_of(size).alias("class"))
        .withColumn("h", F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"-{seed}"))), 1, 13), 16, 10).cast("long"))
    )
    plan, classes = chances(sized, most, weight)
    few = max(plan.count(), classes.count()) <= most_broadcast
    keys = ["source", "class"]
    ranked = _by_class(_by_source(sized, plan, few), classes, few)
    p = F.col("factor") * F.col("size")
    certain = (F.col("rest") > 0) & (F.col("size") > 0) & ~F.coalesce(p < 1, F.lit(False))
    u = (F.col("h") + 0.5) / F.lit(float(1 << 52))
    ranked = ranked.withColumn("chance", F.when(certain, 1.0).when((F.col("rest") > 0) & (F.col("size") > 0), p).otherwise(0.0))
    ranked = ranked.withColumn("q", F.when((F.col("chance") > 0) & (F.col("chance") < 1), (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))))
    # q / (1 + q) spreads the ranks over 0 to 1
    at = F.col("q") / (1 + F.col("q"))
    ranked = ranked.withColumn("bin", F.least(F.floor(at * BINS), F.lit(BINS - 1))).withColumn("fine", F.least(F.floor((at * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)))
    at_rank = ranked.where("q is not null and draws > 0").select(*keys, "draws", "bin", "fine")
    cut = staged(_cut(at_rank.groupBy(*keys, "draws", "bin").agg(F.count("*").alias("n")), keys, "bin", "draws").withColumnRenamed("at", "cut_bin"))
    inner = _by_class(at_rank.drop("draws"), cut, few).where("bin = cut_bin")
    finer = _cut(inner.groupBy(*keys, "cut_bin", "draws", "fine").agg(F.count("*").alias("n")), [*keys, "cut_bin"], "fine", "draws")
    cuts = staged(finer.select(*keys, "cut_bin", F.col("at").alias("cut_fine"), F.col("draws").alias("draws_fine")))
    keyed = _by_class(ranked, cuts, few)
    lower = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("fine") < F.col("cut_fine")))
    edge = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine")), F.lit(False))
    outer = keyed.where(~edge).withColumn("extra", F.when((F.col("chance") == 1) | lower, 1).otherwise(0))
    line = Window.partitionBy(*keys).orderBy("q", "doc_id", "size")
    inside = keyed.where(edge).withColumn("extra", F.when(F.row_number().over(line) <= F.col("draws_fine"), 1).otherwise(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long")
    return outer.unionByName(inside).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "chance")


def _by_class(left: DataFrame, classes: DataFrame, few: bool) -> DataFrame:
    """Left join of a table of classes of sources."""
    met = left["source"].eqNullSafe(classes["source"]) & (left["class"] == classes["class"])
    return left.join(classes.hint("broadcast" if few else "merge"), met, "left").drop(classes["source"], classes["class"])


def _cut(binned: DataFrame, keys: list[str], bin_col: str, need: str) -> DataFrame:
    """The bin in which the running count reaches ``need``, and how many are still needed there."""
    line = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    ran = binned.withColumn("ran", F.sum("n").over(line)).where(F.col("ran") >= F.col(need))
    first = ran.groupBy(*keys).agg(F.min(F.struct(bin_col, (F.col(need) - (F.col("ran") - F.col("n"))).alias("left"))).alias("f"))
    return first.select(*keys, F.col("f")[bin_col].alias("at"), F.col("f.left").alias(need))
