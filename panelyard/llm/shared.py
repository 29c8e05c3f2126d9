"""What the operators of this subpackage share: staging tables and word hashing."""

from __future__ import annotations

import functools
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scans import shared_folder

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def staging_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, read from ``spark.checkpoint.dir``; a local one only for a local master."""
    return shared_folder(spark)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    later plans see real table sizes.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from the columns of ``df``."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def row_key(*columns: Column) -> Column:
    """A 64-bit name of a row by its values; null and empty stay apart."""
    return F.xxhash64(*(x for c in columns for x in (c, c.isNull())))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside space and \\x09-\\x0D, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = values[:n].copy()
    for j in range(1, width):
        h ^= h >> np.uint64(32)
        h *= MULTIPLIER
        h += values[j : j + n]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def portions(texts: list[str | None], most: int = 1_500_000) -> list[slice]:
    """Slices of consecutive texts of about ``most`` characters, so that arrays over them stay small; a longer text stands alone."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            out.append(slice(start, k))
            start, size = k, 0
        size += n + 1
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out


@functools.lru_cache(maxsize=8)
def powers(n: int, base: int = int(MULTIPLIER)) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse, for hashes of stretches by running sums."""
    up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)
