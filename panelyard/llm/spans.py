"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after . ! ? and white space, at line breaks, and before
a capital that follows a word without end mark (a passage pasted into the middle of
a sentence starts there). A sentence of more than ``PIECE`` words is cut further: of
every ``PIECE`` words after its first, the one with the least hash starts a piece. So
no piece has more than ``PIECE`` words, and a cut depends on the ``PIECE - 1`` words on
either side only. Such a piece counts as a sentence in what follows.

From every sentence starts a run: the shortest run of ``least_sentences`` or more
consecutive sentences with ``least_words`` or more words. With the default values a
run has at most 24 words. The cuts of a repeated passage agree from 8 words after its
beginning to 8 words before its end, the first of them is at most 15 words after its
beginning: every repeated passage of 50 words holds a common run, whatever its
sentences are. Up to 15 words at its beginning and 23 at its end can stay.

Each run is hashed to 96 bits (64 and 32 of two hashes); runs are joined over all
documents; every sentence that lies in a run which occurs earlier (by document id, then
a hash of the text, then position) is removed. What is shuffled for every run is kept
narrow: the hash of the text goes along only where an id has several texts.

Defined results: null and empty texts, and texts too short for a run, stay as they
are. Every row stands for itself, also where rows share an id; of rows with equal id
and text one counts as the first, and the others lose all their runs. A null id
neither removes nor loses anything. Other columns are kept as they are, but for a
column with the name of the count, which is replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import SECOND, fresh, mix, powers, row_key, staged, word_hashes

#: What a code point is: white space, line break, end mark, part of a word, capital.
_KINDS = [re.compile(x) for x in (r"\s", r"\n", r"[.!?]", r"\w", r"[^\W\d_a-zß-öø-ÿ]")]
SPACE, BREAK, MARK, WORD, CAPITAL = (1 << k for k in range(len(_KINDS)))
LEAST_SENTENCES, LEAST_WORDS, PIECE = 3, 15, 8


@functools.cache
def _kinds() -> np.ndarray:
    """The kinds of each code point."""
    every, out = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for k, kind in enumerate(_KINDS):
        out[[m.start() for m in kind.finditer(every)]] |= 1 << k
    return out


def _stops(letters: np.ndarray) -> np.ndarray:
    """Ends of white space that follows an end mark, holds a line break, or lies between a word and a capital; and the end of the text."""
    kinds = _kinds()[letters]
    space = (kinds & SPACE) > 0
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, end = edge[space[edge]], edge[~space[edge]]
    if len(space) and space[0]:
        first = np.concatenate(([0], first))
    if len(space) and space[-1]:
        end = np.append(end, len(space))
    broken = np.zeros(len(first), bool)
    breaks = np.flatnonzero(kinds & BREAK)
    broken[np.searchsorted(first, breaks, side="right") - 1] = True
    # a text begins after nothing and ends before nothing
    before, after = np.where(first > 0, kinds[first - 1], 0), np.where(end < len(kinds), kinds[end % max(len(kinds), 1)], 0)
    cut = broken | ((before & MARK) > 0) | (((before & WORD) > 0) & ((after & CAPITAL) > 0))
    stops = end[cut]
    return stops if not len(letters) or (len(stops) and stops[-1] == len(letters)) else np.append(stops, len(letters))


def _least(keyed: np.ndarray) -> np.ndarray:
    """Where each stretch of ``PIECE`` has its least value, the first of equal ones."""
    at, wide = np.arange(len(keyed)), 1
    while wide < PIECE:
        step = min(wide, PIECE - wide)
        left, right = at[:-step], at[step:]
        at = np.where(keyed[left] <= keyed[right], left, right)
        wide += step
    return at


def _cut(text: str) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray | None]:
    """(end of each sentence in code points, number of words up to there, words, their hashes if they were asked for by a long sentence)."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = _stops(letters)
    space = (letters == 32) | ((letters >= 9) & (letters <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(space) else np.zeros(0, np.int64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    upto = np.searchsorted(starts, ends)
    if np.diff(upto, prepend=0).max(initial=0) <= PIECE:
        return ends, upto, words, None
    h = word_hashes(words)
    # where a sentence starts, it takes the place of the word with the least hash
    keyed, begun = h.copy(), np.append(upto[upto < len(words)], 0)
    keyed[begun] = 0
    chosen = np.zeros(len(words), bool)
    chosen[_least(keyed)] = True
    chosen[begun] = False
    fresh = np.flatnonzero(chosen)
    return np.sort(np.concatenate((ends, starts[fresh]))), np.sort(np.concatenate((upto, fresh))), words, h


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, long ones in pieces, in code points, the white space after it included."""
    ends = _cut(text)[0].tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def _stretches(upto: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last) of each run."""
    if len(upto) < least_sentences or upto[-1] < least_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(len(upto))
    stop = np.maximum(start + least_sentences, np.searchsorted(upto, np.concatenate(([0], upto[:-1])) + least_words) + 1)
    start = start[stop <= len(upto)]
    return start, stop[: len(start)]


def runs(text: str, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, number of sentences, two hashes) of each run; the k-th run starts at the k-th sentence."""
    _, upto, words, h = _cut(text)
    start, stop = _stretches(upto, least_sentences, least_words)
    if not len(start):
        none = np.zeros(0, np.uint64)
        return start, stop, none, none
    h = word_hashes(words) if h is None else h
    ends = np.concatenate(([0], upto))
    # the hash of any run of words follows from one running sum over the text
    first, last = ends[start], ends[stop]
    keys = []
    for value, base in ((mix(h), {}), (mix(h ^ SECOND), {"base": int(SECOND)})):
        up, down = powers(1 << len(words).bit_length(), **base)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[: len(words)])))
        keys.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
    return start, stop - start, *keys


def _runs_of(least_sentences: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(t or "", least_sentences, least_words) for t in batch.column(2).to_pylist()]
            if not found:
                continue
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found]))
            first, one, two = (np.concatenate([x[k] for x in found]) for k in (0, 2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                ["doc_id", "row", "first", "run", "run2"],
            )

    return run


def _cut_out(text_at: int, firsts_at: int, names: list[str], least_sentences: int, least_words: int):
    """``firsts_at``: where a row has the runs to take out; the number among equal rows follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, removed = [], []
            for text, firsts, copy in zip(*(batch.column(k).to_pylist() for k in (text_at, firsts_at, firsts_at + 1)), strict=True):
                if not text or not (firsts or copy > 1):
                    new.append(text)
                    removed.append(0)
                    continue
                ends, upto, _, _ = _cut(text)
                start, stop = _stretches(upto, least_sentences, least_words)
                if copy == 1:
                    start, stop = start[firsts], stop[firsts]
                size = len(ends) + 1
                gone = np.cumsum(np.bincount(start, minlength=size) - np.bincount(stop, minlength=size))[:-1] > 0
                # sentences that stay side by side are one slice
                turn = np.flatnonzero(np.diff(gone, prepend=True, append=True))
                at = np.concatenate(([0], ends))[turn].tolist()
                new.append("".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
                removed.append(int(gone.sum()))
            columns = [pa.array(new, pa.string()) if k == text_at else batch.column(k) for k in range(firsts_at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names)

    return run


def remove_repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, count_col: str = "sentences_removed") -> DataFrame:
    """The rows of ``docs`` with repeated sentences cut out of the text, and how many in ``count_col``."""
    docs = docs.drop(count_col)
    kind = docs.schema[id_col].dataType.simpleString()
    span_doc, span_row, firsts, copy, key, told = fresh(docs, "doc", "row", "firsts", "copy", "key", "told")
    # ids of several texts; the table is written, so that its real size decides how it is joined
    h = row_key(F.col(text_col))
    several = staged(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(told)).agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select(told))
    keyed = docs.join(several, F.col(id_col) == F.col(told), "left").withColumn(key, F.when(F.col(told).isNotNull() | F.col(id_col).isNull(), h).otherwise(F.lit(0).cast("long"))).drop(told)
    texts = keyed.select(F.col(id_col).alias("doc_id"), F.col(key).alias("row"), F.col(text_col).alias("text")).where("doc_id is not null")
    # rows of equal id and text have the same runs, which count once
    found = staged(texts.mapInArrow(_runs_of(least_sentences, least_words), f"doc_id {kind}, row long, first int, run long, run2 int"))
    place = F.struct("doc_id", "row", "first")
    # a run and a count tell which runs may have several places (rows of equal id and text count too, and go again with their one place); tables are written, so that both sides of a join are shuffled and a run that a third of all texts hold is split
    repeated = staged(found.groupBy("run").agg(F.count("*").alias("times")).where("times > 1").select("run"))
    again = staged(found.join(repeated.hint("merge"), "run", "left_semi"))
    kept = staged(again.groupBy("run", "run2").agg(F.min(place).alias("kept")))
    later = again.join(kept.hint("merge"), ["run", "run2"]).where(place != F.col("kept"))
    # one row of spans for each text: bounded by the text's own sentences
    spans = later.groupBy(F.col("doc_id").alias(span_doc), F.col("row").alias(span_row)).agg(F.array_sort(F.collect_set("first")).alias(firsts))
    joined = keyed.join(spans.hint("merge"), (F.col(id_col) == F.col(span_doc)) & (F.col(key) == F.col(span_row)), "left")
    # rows of equal id and text lie together after the join
    number = F.when(F.col(id_col).isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(id_col, key).orderBy(id_col, key)))
    names = [*docs.columns, count_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{count_col}` long"
    cut = _cut_out(docs.columns.index(text_col), len(docs.columns), names, least_sentences, least_words)
    return joined.select(*docs.columns, firsts, number.alias(copy)).mapInArrow(cut, schema)
