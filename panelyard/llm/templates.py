"""Benchmark decontamination by template canonicalisation.

Words become lower-cased tokens; numbers, names (capitalised words inside a
sentence) and units turn into the typed placeholders <num>, <name> and <unit>.
Windows of ``width`` canonical tokens of documents and items are joined by hash, so
an item is found although its numbers, names or units were exchanged. A window of
placeholders alone says nothing (every table of numbers has it): such a window, and
an item of fewer tokens than ``width``, is compared by its words as they are. Matched
windows are grouped by (document, item, offset), and the slots must be consistent:
within a group, one value of the item always stands against one value in the
document, and the other way round. A document is contaminated by an item if
consistent groups cover ``share`` of the item's tokens.

Items of one class, those with the same windows whose slots are equal and unequal at the same
places, have the same matches. So documents meet classes, not items: a frame that thousands of
items fill with other numbers is one class, or a few. A class is named by its smallest
item id; `members` tells which items it has. Many classes may share a common phrase. So a document first
meets each class by one run of the class's windows, the run that fewest classes share, chosen so long that a
document that has none of them cannot cover ``share`` of the tokens; only then by all windows.

Windows of documents pass a Bloom filter of the items' windows, of bounded size,
before the join; the join decides.

Defined results: null and word-less texts match nothing. An item of fewer tokens
than ``width`` is found anywhere in a text, word for word. Rows that share an id count
as one document; null ids are not reported. Repeated items count once for each id; an id
with several texts is in the class of each.
Ids may be of any type. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import mix, portions, rolling, signed, staged

WIDTH, SHARE = 5, 0.8
#: Bits of the filter of item windows, as a power of two: at least, at most (8 MB).
LEAST_BITS, MOST_BITS = 16, 26
#: A worker forgets the codes of words beyond so many, and looks up the words of about so many characters at once.
MOST_REMEMBERED, PORTION = 400_000, 4_000_000

# Unit words and signs.
UNITS = frozenset(
    "% mm cm m km in ft yd mi mg g kg lb oz ml l dl s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp $ € £ dollars dollar euros euro cents cent percent degrees degree °c °f k w kw kwh j kj cal kcal v hz khz mhz ghz mph kmh km/h m/s miles mile meters meter metres metre kilometers kilometres grams gram kilograms kilogram pounds pound litres liters litre liter inches inch feet foot".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
_EDGE = "\"'“”‘’()[]{}<>.,;:!?*_"
WORD_FOR_WORD = 0x9D5C3B1A7F2E4680
NUM, NAME, UNIT = (xxhash.xxh3_64_intdigest(x) for x in (b"<num>", b"<name>", b"<unit>"))
#: Bits of a word's code.
IS_NUM, IS_UNIT, IS_CAPITAL, ENDS = 1, 2, 4, 8


class _Codes:
    """What a worker remembers of words: for each a number, and by number the value hash and the bits."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.value, self.bits = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def learn(self, words: set[str]) -> None:
        """Number words that are new."""
        number, digest = self.number, xxhash.xxh3_64_intdigest
        value, bits = [], []
        for word in words:
            number[word] = len(number)
            bare = word.strip(_EDGE)
            # only what was stripped can end a sentence
            b = 0 if bare == word else ENDS if word.rstrip("\"'”’)")[-1:] in (".", "!", "?", ":") else 0
            bare = bare or word
            low = bare.lower()
            first = bare[0]
            if low in _WORDS or ((first.isdigit() or first in "+-$€£") and _NUMBER.fullmatch(bare)):
                b |= IS_NUM
            elif low in UNITS:
                b |= IS_UNIT
            elif first.isupper() and not (len(bare) > 1 and bare.isupper()):
                b |= IS_CAPITAL
            value.append(digest(low.encode("utf-8", "surrogatepass")))
            bits.append(b)
        self.value = np.concatenate((self.value, np.array(value, np.uint64)))
        self.bits = np.concatenate((self.bits, np.array(bits, np.int8)))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(value hashes, bits) of the words of some texts."""
        self.learn(set(words).difference(self.number))
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.value[at], self.bits[at]


def canonical(texts: list[str | None], codes: _Codes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token hashes, value hashes, is a slot) of each text; all words of the texts are looked up together."""
    words = [(t or "").split() for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    value, bits = codes.of(list(chain.from_iterable(words)))
    starts = np.ones(len(bits) + 1, bool)
    starts[1:] = (bits & ENDS) > 0
    starts[ends] = True
    name = ((bits & IS_CAPITAL) > 0) & ~starts[:-1]
    token = value.copy()
    for mark, placeholder in ((bits & IS_NUM, NUM), (bits & IS_UNIT, UNIT), (name, NAME)):
        token[mark > 0] = np.uint64(placeholder)
    slot = name | ((bits & (IS_NUM | IS_UNIT)) > 0)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield token[a:b], value[a:b], slot[a:b]


def keyed(token: np.ndarray, value: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """One key for each window of ``width`` tokens: by its template, or by its words where all of them are slots."""
    h = rolling(token, width)
    slots = np.concatenate(([0], np.cumsum(slot)))
    bare = np.flatnonzero(slots[width:] - slots[:-width] == width) if len(h) else np.zeros(0, np.int64)
    if len(bare):
        h[bare] = rolling(value, width)[bare] ^ np.uint64(WORD_FOR_WORD)
    return h ^ np.uint64(width)


def literal(value: np.ndarray, width: int) -> np.ndarray:
    """One key for each ``width`` words as they are."""
    return rolling(value, width) ^ np.uint64(WORD_FOR_WORD) ^ np.uint64(width)


class Filter:
    """A Bloom filter with two places a key, and the widths of items shorter than a window."""

    def __init__(self, words: np.ndarray, short: list[int]):
        self.words, self.short = words, short

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & np.uint64(len(self.words) * 64 - 1)
            out &= ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def filter_of(items: DataFrame, width: int) -> Filter:
    """The filter of the items' windows: its words are grouped sums of bits, at most 2^(MOST_BITS - 6) rows."""
    windows_ = items.select("window", "width").distinct()
    facts = windows_.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("width") < width, F.col("width"))).alias("short")).first()
    bits = min(max(LEAST_BITS, int(facts["n"] * 16).bit_length()), MOST_BITS)
    places = F.explode(F.array(*(F.shiftrightunsigned("window", k).bitwiseAND(F.lit((1 << bits) - 1)) for k in (0, 32)))).alias("at")
    rows = windows_.select(places).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words, sorted(facts["short"]))


def _found(token: np.ndarray, value: np.ndarray, slot: np.ndarray, width: int, wanted: Filter | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, keys, width) of the windows of a text; of an item (no filter) all of them."""
    n = len(token)
    if wanted is None:
        yield (np.arange(n - width + 1), keyed(token, value, slot, width), width) if n >= width else (np.zeros(min(n, 1), np.int64), literal(value, n) if n else value, n)
        return
    for w in (*wanted.short, width):
        if n >= w:
            h = keyed(token, value, slot, w) if w == width else literal(value, w)
            where = np.flatnonzero(wanted.passes(h))
            yield where, h[where], w


def numbered(value: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The slots' values by number, counted in the order in which they first occur; 0 elsewhere."""
    out = np.zeros(len(value), np.int64)
    _, first, back = np.unique(value[slot], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    out[slot] = rank[back]
    return out


def shape(keys: np.ndarray, slots: np.ndarray, n_tokens: int) -> bytes:
    """The name of an item's class: its windows, its length, and which of its slots are equal."""
    return xxhash.xxh3_128_digest(b"%d %d " % (n_tokens, len(keys)) + keys.tobytes() + slots.tobytes())


def _windows(width: int, shared):
    """shared: a broadcast filter that windows must pass, or None for all windows of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        wanted = None if shared is None else shared.value
        for batch in batches:
            owners, texts = batch.column(0), batch.column(1).to_pylist()
            for part in portions(texts, PORTION):
                if len(codes.number) > MOST_REMEMBERED:
                    codes = _Codes()
                at, pos, keys, length, slots, sizes, shapes = [], [], [], [], [], [], []
                for k, (token, value, slot) in enumerate(canonical(texts[part], codes), part.start):
                    for where, h, w in _found(token, value, slot, width, wanted):
                        if not len(where):
                            continue
                        v = signed(mix(value)) if wanted is not None else numbered(value, slot)
                        if wanted is None:
                            shapes += [shape(h, v[slot] if w == width else v[:0], len(token))] * len(where)
                        at.append(np.full(len(where), k))
                        pos.append(where)
                        keys.append(signed(h))
                        length.append(np.full(len(where), len(token)))
                        sizes.append(np.full(len(where), w))
                        # words that are compared as they are need no slots
                        slots += [v[p + np.flatnonzero(slot[p : p + w])] if w == width else v[:0] for p in where.tolist()]
                if not at:
                    continue
                columns = {
                    "owner": owners.take(pa.array(np.concatenate(at))), "pos": pa.array(np.concatenate(pos).astype(np.int32)), "window": pa.array(np.concatenate(keys)),
                    "n_tokens": pa.array(np.concatenate(length).astype(np.int32)), "width": pa.array(np.concatenate(sizes).astype(np.int32)), "slots": pa.array(slots, pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"shape": pa.array(shapes, pa.binary())} if wanted is None else {}))

    return run


def windows(table: DataFrame, id_col: str, text_col: str, width: int = WIDTH, shared=None) -> DataFrame:
    """Windows of the rows with an id; of items (no filter) with the class of the item."""
    kind = table.schema[id_col].dataType.simpleString()
    return table.select(F.col(id_col).alias("owner"), F.col(text_col).alias("text")).where("owner is not null").mapInArrow(
        _windows(width, shared), f"owner {kind}, pos int, window long, n_tokens int, width int, slots array<long>" + (", shape binary" if shared is None else "")
    )


def members(benchmark: DataFrame, *, item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id, representative): the smallest item id of each class that the item is in; items without a word are in none."""
    own = staged(windows(benchmark, item_col, item_text, width).select("owner", "shape").distinct())
    least = own.groupBy("shape").agg(F.min("owner").alias("representative"))
    return own.join(least.hint("merge"), "shape").select(F.col("owner").alias("item_id"), "representative").distinct()


def seeds(items: DataFrame, share: float) -> DataFrame:
    """(shape, window, width) of one run of windows of each class.

    A document without any window of a run of n_tokens - ceil(share n_tokens) + width windows leaves so many tokens
    uncovered that it misses ``share``. The windows of a class are cut into runs of at least that length (a
    class of fewer windows is one run), and the run stays whose windows the fewest classes have.
    """
    common = items.groupBy("window", "width").agg(F.count("*").alias("n"))
    least = F.col("item_tokens") - F.ceil(share * F.col("item_tokens")) + F.col("width")
    runs = F.greatest(F.floor((F.col("item_tokens") - F.col("width") + 1) / least), F.lit(1))
    rows = staged(items.join(common.hint("merge"), ["window", "width"]).select("shape", "window", "width", "n", F.least(F.floor(F.col("item_pos") / least), runs - 1).alias("run")))
    rarest = rows.groupBy("shape", "run").agg(F.sum("n").alias("n")).groupBy("shape").agg(F.min(F.struct("n", "run")).alias("least"))
    return rows.join(rarest.select("shape", F.col("least.run").alias("run")).hint("merge"), ["shape", "run"]).select("shape", "window", "width").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_items, covered, n_tokens) for each document and class of items that it holds; item_id is the class's smallest, n_items its size."""
    rows = staged(windows(benchmark, item_col, item_text, width))
    classes = rows.groupBy("shape").agg(F.min("owner").alias("item_id"), F.countDistinct("owner").alias("n_items"))
    items = staged(rows.drop("owner").dropDuplicates(["shape", "pos"])).withColumnsRenamed({"pos": "item_pos", "n_tokens": "item_tokens", "slots": "item_slots"})
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(items, width))
    hits = staged(windows(docs, id_col, text_col, width, wanted))
    maybe = staged(hits.select("owner", "window", "width").distinct().join(seeds(items, share).hint("merge"), ["window", "width"]).select("owner", "shape").distinct())
    met = maybe.join(items.hint("merge"), "shape").join(hits.drop("n_tokens").hint("merge"), ["owner", "window", "width"])
    met = staged(met.where(F.size("slots") == F.size("item_slots")).withColumn("offset", F.col("pos") - F.col("item_pos")))
    group = ["owner", "shape", "offset"]
    pairs = met.select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*group, F.col("s.item_slots").alias("x"), F.col("s.slots").alias("y")).distinct()
    clash = pairs.groupBy(*group).agg(F.count("*").alias("n"), F.countDistinct("x").alias("xs"), F.countDistinct("y").alias("ys")).where("n > xs or n > ys").select(*group)
    sound = met.join(clash.hint("merge"), group, "left_anti")
    token = F.explode(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("width") - 1))
    covered = sound.select("owner", "shape", "item_tokens", token.alias("t")).distinct().groupBy("owner", "shape", "item_tokens").agg(F.count("*").alias("covered"))
    covered = covered.where(F.col("covered") >= share * F.col("item_tokens"))
    return covered.join(classes.hint("merge"), "shape").select(F.col("owner").alias("doc_id"), "item_id", "n_items", "covered", F.col("item_tokens").alias("n_tokens"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, n_items (items of all its classes), items (the smallest of each class, sorted)."""
    return leaks(docs, benchmark, **options).groupBy("doc_id").agg(F.sum("n_items").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"))
