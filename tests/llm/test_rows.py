"""Repeated and null ids, equal rows and clashing columns, and the inclusion odds of the mix."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from panelyard.llm import htmltext, minhash, mixing, spans, templates

PASSAGE = " ".join(f"Word{i} goes over hill number {i}." for i in range(20))


def test_spans_of_repeated_ids_and_equal_rows(spark):
    rows = [(1, PASSAGE, "a"), (2, "An intro here. " + PASSAGE, "b"), (2, "Short one.", "c"), (3, PASSAGE, "d"), (3, PASSAGE, "e"), (None, PASSAGE, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sentences_removed string")
    got = sorted((x.doc_id or 0, x.sentences_removed, x.text) for x in spans.remove_repeated_spans(docs).collect())
    assert got == [(0, 0, PASSAGE), (1, 0, PASSAGE), (2, 0, "Short one."), (2, 20, "An intro here. "), (3, 20, ""), (3, 20, "")]
    alone = spans.remove_repeated_spans(docs.where("doc_id = 3")).collect()
    assert sorted(x.text for x in alone) == ["", PASSAGE]


def test_near_duplicates_of_ids_with_two_texts(spark):
    one, two = "a b c d e f g h i j k l", "z y x w v u t s"
    docs = spark.createDataFrame([(9, one), (4, one), (4, two), (7, two)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs).collect())
    assert got == [(4, 6, 4), (4, 10, 4), (7, 6, 4), (9, 10, 4)]


def test_long_lists_get_their_own_stars(spark, monkeypatch):
    base = [f"b{i}" for i in range(120)]
    lines = [[f"l{k}w{j}" for j in range(7)] for k in range(6)]
    texts = [" ".join(base + lines[i % 6] + lines[(i * 5 + 1) % 6] + [f"u{i}x{j}" for j in range(i % 9)]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(docs, percent=88).collect()))
    monkeypatch.setattr(minhash, "SHORT", 3)
    assert sorted(map(tuple, minhash.near_duplicates(docs, percent=88).collect())) == want


def test_mix_odds_sizes_and_shuffle(spark):
    sizes = [3, 9, 10, 11, 12, 13, 40, 41, 47, 200]
    rows = [(s * 100 + i, "w " * sizes[i % 10], f"s{s:03d}") for s in range(400) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.col("place") % 2 + 1
    got = mixing.mix(docs, weight=weight).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs, weight=weight, most_broadcast=0).collect()))
    whole = {x.doc_id // 100: int(x.target // x.source_size) for x in got}
    drawn, hoped, times = defaultdict(int), defaultdict(float), defaultdict(int)
    for x in got:
        place = (whole[x.doc_id // 100], x.size)
        extra = x.copies - place[0]
        assert extra in (0, 1) and (extra == x.chance or 0 < x.chance < 1)
        drawn[place] += extra
        hoped[place] += x.chance
        times[place] += 1
    # documents are drawn as often as their odds say, and odds differ by size
    assert all(abs(drawn[p] - hoped[p]) < 4.5 * max(times[p] ** 0.5 / 2, 1) for p in times)
    assert len({round(hoped[p] / times[p], 3) for p in times if p[0] == 0}) > 4
    # sample sizes are fixed: every source of one kind draws the same number
    number = defaultdict(int)
    for x in got:
        number[x.doc_id // 100] += x.copies
    assert len({(whole[s], n) for s, n in number.items()}) == len({*whole.values()})


def test_short_items_and_tables_of_numbers(spark):
    bench = spark.createDataFrame([(1, "who wrote Faust"), (2, "12 15 18 20 22 25"), (2, "12 15 18 20 22 25")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "he asked who wrote Faust and why", 1), (2, "table 1 2 3 4 5 6 7", 2), (3, "x 12 15 18 20 22 25 y", 3), (3, "other", 4)], "doc_id long, text string, window int")
    assert {(x.doc_id, x.item_id) for x in templates.leaks(docs, bench).collect()} == {(1, 1), (3, 2)}


def test_page_blocks_count_whole_and_in_pieces():
    assert [b.text for b in htmltext.blocks("<p title=it's>Text one</p><p class='a>b'>two<br>three</p>")] == ["Text one", "two three"]
    describe = htmltext.Describer()
    block = lambda path, text: htmltext.Block(htmltext.path_of(path), text, 0)
    x = describe([block(("aside",) + ("div",) * 9, "w"), block(("article",) + ("div",) * 9, "w"), block((), "w " * 300 + "a"), block((), "w " * 300 + "b")])
    assert abs(x[0] - x[1]).sum() > 0.1 and abs(x[2] - x[3]).sum() > 0.1
    page = [block(("div",) * (1 + k % 5), f"word{k} z") for k in range(50)]
    model = htmltext.Labeller()
    whole, on, _ = htmltext.padded([(describe(page), [0] * 50)])
    assert abs(model.margins(whole, on)[0] - model.of_long_page(page, describe, 7)).max() < 1e-4
    assert len(htmltext.blocks("<div>x" * 4000)) == 4000


ROWS = [
    (1, PASSAGE, "en", "a", 5, "x"), (1, PASSAGE, "en", "a", 5, "y"), (2, "Before it. " + PASSAGE + " After " * 70, None, "b", None, "z"), (None, PASSAGE, None, None, 1, None),
    (None, None, None, None, None, None), (4, "", "de", "b", 0, "e"), (5, "who wrote the long book about Faust in Weimar", "en", "a", 3, "q"), (5, "a clean text of some words", "en", "a", 3, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grade string"


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    spark.createDataFrame([(1, "who wrote the long book about Faust in Weimar")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = {name: lambda d, f=f: f(spark, d, str(tmp_path)) for name, f in pipeline.STAGES}
    texts = lambda df: sorted((x.doc_id or 0, x.text or "") for x in df.collect())
    assert texts(run["toxicity"](docs)) == texts(docs)
    # equal and near texts: the smallest id stays, once; word-less rows stay
    assert texts(run["near_dedup"](docs)) == sorted((x[0] or 0, x[1] or "") for x in (ROWS[0], *ROWS[4:]))
    cut = run["span_dedup"](docs).collect()
    assert sorted(x.doc_id or 0 for x in cut) == sorted(x[0] or 0 for x in ROWS)
    assert sum(x.text == "" for x in cut if x.doc_id == 1) == 1 and all(x.n_chars == len(x.text) for x in cut if x.doc_id == 2)
    assert texts(run["decontamination"](docs)) == sorted((x[0] or 0, x[1] or "") for x in (*ROWS[:6], ROWS[7]))
    mixed, plan = run["mixing"](docs).collect(), mixing.mix(docs).collect()
    words = lambda rows: sum(len((x.text or "").split()) for x in rows)
    assert abs(words(mixed) - sum(x.taken for x in plan)) <= 2 * max(x.size for x in plan)
    assert all(x.copy >= 1 for x in mixed)
    for name, stage in run.items():
        assert stage(docs.limit(0)).count() == 0, name
        if name != "mixing":
            assert stage(docs).columns == docs.columns
