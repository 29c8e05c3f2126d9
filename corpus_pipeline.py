"""A training corpus from documents: five stages, each a table of documents.

Toxic documents go; one document of each near-duplicate group stays; repeated
sentence spans are cut out; documents that hold benchmark items go; what is left is
mixed to the target weights of its sources.

Rows are told apart by their values, so null and repeated ids, equal rows and extra
columns are allowed in every stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm import minhash, mixing, spans, templates, toxicity
from panelyard.llm.shared import fresh, row_key, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two hashes that name a row by its values in ``columns``."""
    names = fresh(docs, "k1", "k2")
    of = [F.col(c) for c in columns]
    return docs.withColumns({names[0]: row_key(*of), names[1]: row_key(F.lit(1), *of)}), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: rows that the severity model rejects go; null and empty texts stay."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    names = fresh(docs, "severity", "p_toxic", "grade", "rejected")
    return toxicity.grade(docs, model, names=tuple(names)).where(~F.col(names[-1])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one row of each group stays, the one of the smallest id (null ids last), five-word shingles at 0.8.

    Of rows with equal id and text one stays; rows without a word are no duplicates and stay.
    """
    keyed, keys = _keyed(docs, "doc_id", "text")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keys, 1)))
    found = minhash.near_duplicates(keyed.select(name.alias("doc_id"), "text"), width=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id.k1").alias(keys[0]), F.col("doc_id.k2").alias(keys[1])).distinct()
    left = keyed.join(gone.hint("merge"), keys, "left_anti")
    (number,) = fresh(left, "number")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).where((F.col(number) == 1) | ~worded).select(*docs.columns)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: sentences of a run that an earlier row has are cut out; n_chars follows the text."""
    (count,) = fresh(docs, "removed")
    cut = spans.remove_repeated_spans(docs, count_col=count)
    return cut.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: rows that hold a benchmark item go, those without id too."""
    keyed, keys = _keyed(docs, "text")
    found = templates.contaminated(keyed.select(F.struct(*keys).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark")).select(*(F.col(f"doc_id.{k}").alias(k) for k in keys))
    return keyed.join(found.hint("merge"), keys, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the mixed corpus, one row for each copy that the mix takes (``copy`` counts from 1).

    What equal rows take together is dealt out among them, one by one.
    """
    keyed, keys = _keyed(docs, "doc_id", "text", "source")
    mixed = mixing.mix(keyed.select(F.struct(*keys).alias("doc_id"), "text", "source"))
    total, rows, number = fresh(keyed, "total", "rows", "number")
    taken = mixed.groupBy(*(F.col(f"doc_id.{k}").alias(k) for k in keys)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    joined = keyed.join(taken.hint("merge"), keys).withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    own = F.floor(F.col(total) / F.col(rows)) + F.when(F.col(number) <= F.col(total) % F.col(rows), 1).otherwise(0)
    own_columns = [c for c in docs.columns if c.lower() != "copy"]
    return joined.withColumn(total, own.cast("int")).where(F.col(total) > 0).select(*own_columns, F.explode(F.sequence(F.lit(1), F.col(total))).alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("span_dedup", cut_repeated_spans),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs


#: The stages learn a model and draw by hashes of Python code, so SQL gives no oracle.
ORACLE_SQL = None
