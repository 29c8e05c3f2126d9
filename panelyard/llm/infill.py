"""Fill-in-middle transformation: prefix, middle and suffix of a text, cut at line ends, in a new order.

A text is looked at as 64-bit words of its UTF-8 bytes. Bytes that end a unit are marked
arithmetically, eight at a time; the number of marks in each word and its running sum say
in which word the k-th end lies, and clearing the lowest marks of that word says where.
Code points are counted the same way, from the bytes that begin none.

Units are lines with their line feed; what follows the last one is a unit if it is not
empty. Two numbers drawn from the id choose how many units the prefix and the prefix with
the middle have, two more the form.

Defined results: null text is empty. An empty text, and one that holds a marker, stays as
it is (form ``plain``; no cut, so ``prefix_chars`` and ``middle_chars`` are null). A null
id draws like the text ''. Rows that share an id are cut by the same numbers. Texts are
never cut short. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Shares, in percent, of texts that are transformed, and of those whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50

ONES, LOW, HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
LINE_FEED = ONES * np.uint64(0x0A)
ONE = np.uint64(1)


def as_words(text: bytes) -> np.ndarray:
    """The bytes as little-endian 64-bit words, zeros behind."""
    return np.frombuffer(text + bytes(-len(text) % 8), "<u8")


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a line feed; no carry leaves a byte."""
    x = words ^ LINE_FEED
    return ~(((x & LOW) + LOW) | x | LOW)


def later_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a code point (10xxxxxx)."""
    return words & HIGH & ~((words << ONE) & HIGH)


class Ends:
    """The ends of a text's units: how many there are, and the place of the k-th."""

    def __init__(self, text: bytes) -> None:
        self.size = len(text)
        self.words = as_words(text)
        self.marks = unit_ends(self.words)
        self.upto = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)
        self.fed = int(self.upto[-1]) if self.size else 0
        # an open last line is a unit as well
        self.units = self.fed + (self.size > 0 and text[-1] != 0x0A)

    def end(self, k: int) -> int:
        """The byte behind the k-th unit; 0 for k = 0."""
        if k <= 0:
            return 0
        if k > self.fed:
            return self.size
        at = int(np.searchsorted(self.upto, k))
        word = int(self.marks[at])
        for _ in range(k - 1 - (int(self.upto[at - 1]) if at else 0)):
            word &= word - 1
        return 8 * at + ((word & -word).bit_length() + 7) // 8

    def points(self, start: int, stop: int) -> int:
        """Code points that begin between two bytes."""
        first, last = start // 8, -(-stop // 8)
        marks = later_bytes(self.words[first:last])
        if not len(marks):
            return 0
        marks = marks.copy()
        marks[0] &= ~np.uint64((1 << 8 * (start - 8 * first)) - 1)
        if over := 8 * last - stop:
            marks[-1] &= np.uint64((1 << 8 * (8 - over)) - 1)
        return stop - start - int(np.bitwise_count(marks).sum(dtype=np.int64))


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))


def transformed(text: bytes, doc_id: object, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = Ends(text)
    n = ends.units
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends.end(first), ends.end(second)
    p, s, m = marks
    spm = h4 % 100 < suffix_first
    parts = (s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])
    return n, "spm" if spm else "psm", ends.points(0, a), ends.points(a, b), b"".join(parts)


def _transform(rate: int, suffix_first: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(1).to_pylist(), batch.column(2).fill_null("").cast(pa.binary())
            # one text at a time is held beside the batch
            made = [transformed(t.as_py(), i, rate, suffix_first, seed) for i, t in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_transform(rate, suffix_first, seed), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text from its output and form. No marker occurs in a part, and none arises where parts and markers meet."""
    first, second = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one, rest = F.split_part(body, first, F.lit(1)), F.split_part(body, first, F.lit(2))
    two, middle = F.split_part(rest, second, F.lit(1)), F.split_part(rest, second, F.lit(2))
    whole = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(whole)


def digests(docs: DataFrame, **options) -> DataFrame:
    """``fill_in_middle`` with SHA-256 of the output and of the text rebuilt from it, instead of the output."""
    made = fill_in_middle(docs, **options)
    own = made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("form"), F.col("output")), 256)})
    return own.drop("output")
