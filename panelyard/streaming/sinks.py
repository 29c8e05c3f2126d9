"""A table that a stream keeps up to date: buckets of keys, versions of buckets, and a manifest for each batch.

A batch reads the buckets that its keys lie in, merges, and writes them anew under its own
number. Then it writes a manifest: for every bucket the batch that wrote it last. Readers
take the manifest with the highest number and nothing else, so

- a read costs what the keys need, however many batches there were;
- a batch that died before its manifest leaves files that no manifest names, and runs
  again from the manifest before it;
- a batch that ran twice has merged once.

Versions that neither of the last two manifests names are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class BucketTable:
    """``keys`` tell rows apart; ``merge`` makes one row a key out of old and new ones."""

    def __init__(self, spark: SparkSession, where: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], schema: StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.where, self.keys, self.merge, self.schema, self.buckets = spark, where.rstrip("/"), list(keys), merge, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, kind: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{kind}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _numbers(self, kind: str) -> list[int]:
        """The batches that have finished a folder of a kind."""
        fs, path = self._folder(kind)
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> batch, of the last manifest (before a batch). A row for each bucket."""
        known = [n for n in self._numbers("manifest") if before is None or n < before]
        return {r.bucket: r.batch for r in self.spark.read.schema("bucket int, batch long").parquet(f"{self.where}/manifest/batch={known[-1]}").collect()} if known else {}

    def _read(self, versions: dict[int, int], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        paths = [f"{self.where}/data/batch={n}/bucket={b}" for b, n in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def write_data(self, batch: DataFrame, number: int) -> dict[int, int]:
        """Merge a batch into the buckets of its keys; returns the manifest that it should get."""
        versions = self.manifest(before=number)
        fresh = self.merge(batch.select(*self.schema.names)).select(*self.schema.names).persist()
        try:
            touched = [r[0] for r in fresh.select(self.bucket()).distinct().collect()]
            old = self._read({b: n for b, n in versions.items() if b in touched}, batch.sparkSession)
            merged = self.merge(old.unionByName(fresh)).withColumn("bucket", self.bucket())
            merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.where}/data/batch={number}")
        finally:
            fresh.unpersist()
        return versions | dict.fromkeys(touched, number)

    def write_manifest(self, versions: dict[int, int], number: int) -> None:
        rows = self.spark.createDataFrame(sorted(versions.items()), "bucket int, batch long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.where}/manifest/batch={number}")

    def vacuum(self) -> None:
        """Remove versions of buckets that neither of the last two manifests names, and older manifests."""
        kept = self._numbers("manifest")[-2:]
        named = {(n, b) for k in kept for b, n in self.manifest(before=k + 1).items()}
        if not kept:
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs, data = self._folder("data")
        for n in self._numbers("data"):
            if n > kept[-1]:
                continue
            own = {b for m, b in named if m == n}
            folder = path(data, f"batch={n}")
            if not own:
                fs.delete(folder, True)
                continue
            for s in fs.listStatus(folder):
                name = s.getPath().getName()
                if name.startswith("bucket=") and int(name.split("=")[1]) not in own:
                    fs.delete(s.getPath(), True)
        fs, manifests = self._folder("manifest")
        for n in self._numbers("manifest")[:-2]:
            fs.delete(path(manifests, f"batch={n}"), True)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch, as ``foreachBatch`` calls it."""
        self.write_manifest(self.write_data(batch, number), number)
        self.vacuum()
