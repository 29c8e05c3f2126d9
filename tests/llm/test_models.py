import random

import numpy as np
from pyspark.sql import functions as F

from panelyard.llm import htmltext, quality, toxicity

CALM = "the of and house river walk green table some long word here there bridge paper cloud".split()
RUDE = ["idiot", "scum", "moron", "trash"]


def corpus(r, n):
    rows = []
    for i in range(n):
        words = [r.choice(CALM) for _ in range(r.randint(5, 60))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        for _ in range(toxic * r.randint(1, 5)):
            words.insert(r.randrange(len(words)), r.choice(RUDE))
        text = " ".join(words) if good else " | ".join(w.upper() + "%%%" for w in words)
        rows.append((i, text, "src", toxic, good))
    return rows


def test_toxicity_on_rows_left_out(spark):
    rows = corpus(random.Random(1), 600)
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows if x[0] < 400], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {x.doc_id: x for x in toxicity.grade(docs, model).collect()}
    right = [got[x[0]].rejected == bool(x[3]) for x in rows if x[0] >= 400]
    assert np.mean(right) > 0.97
    assert all(0 <= g.severity <= toxicity.GRADES for g in got.values())
    many = [g.severity for i, g in got.items() if rows[i][1].count("idiot") + rows[i][1].count("scum") >= 3]
    assert not many or np.mean(many) > np.mean([g.severity for g in got.values() if g.rejected])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "idiot " * 9000, 3)], "doc_id long, text string, n int")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.grade(docs, toxicity.train(docs, empty)).collect()
    assert len(got) == 3 and not any(x.rejected for x in got)
    assert toxicity.grade(docs.limit(0), toxicity.train(docs, empty)).count() == 0


def test_quality_on_rows_left_out(spark):
    rows = corpus(random.Random(2), 700)
    docs = spark.createDataFrame([(*x[:3], None) for x in rows], "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame([(x[0], x[4]) for x in rows], "doc_id long, quality int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    got = {x.doc_id: x for x in quality.score(docs, labels, held).collect()}
    out = [(got[x[0]].predicted, x[4]) for x in rows if got[x[0]].held_out]
    assert len(out) > 100 and np.mean([a == b for a, b in out]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())


def test_pair_term_equals_the_double_sum():
    r = np.random.default_rng(0)
    m = quality.Machine(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 0.3, r.normal(size=(1 << quality.BITS) + quality.STATISTICS), r.normal(size=((1 << quality.BITS) + quality.STATISTICS, quality.RANK)))
    ids, x, start = m.rows([quality.inputs("a b c a", quality._Words()), quality.inputs(None, quality._Words())])
    z, _, _ = m.margin(ids, x, start)
    for row, (lo, hi) in enumerate(((0, start[1]), (start[1], len(ids)))):
        i, v = ids[lo:hi], x[lo:hi]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(z[row] - (m.bias + m.w[i] @ v + pairs)) < 1e-6


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "x " * 50000)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in quality.score(docs, empty, F.lit(False)).collect()] == [0.5] * 3
    assert quality.score(docs.limit(0), empty, F.lit(False)).count() == 0


def page(r, k):
    body = [" ".join(r.choice(CALM) for _ in range(r.randint(8, 40))).capitalize() + "." for _ in range(r.randint(1, 5))]
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(CALM, 4))
    html = f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul>{menu}</ul></nav><div class=\"ad\">Buy {r.choice(CALM)} now</div><article><h1>Head {k}</h1>"
    html += "".join(f"<p>{t.replace('house', 'ho&#117;se')}\n  " for t in body) + "</article><footer>&copy; all rights</footer>"
    return html, "\n".join([f"Head {k}", *body])


def test_main_text_of_pages(spark):
    r = random.Random(3)
    made = [page(r, k) for k in range(60)]
    rows = [(k, f"u{k}", h) for k, (h, _) in enumerate(made)] + [(100, "u", None), (101, "u", ""), (102, "u", "<p>unclosed <b")]
    got = {x.page_id: x for x in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert np.mean([got[k].text == want for k, (_, want) in enumerate(made)]) > 0.9
    assert got[100].text == "" and got[101].n_chars == 0 and all(x.n_chars == len(x.text) for x in got.values())


def test_labeller_gradient():
    r = np.random.default_rng(2)
    model = htmltext.Labeller()
    pages = [(r.normal(size=(n, htmltext.PATH + htmltext.WORDS + htmltext.COUNTS)).astype(np.float32), (r.random(n) < 0.5).astype(float)) for n in (3, 5)]
    x, on, y = htmltext.padded(pages)

    def loss():
        z = model.margins(x, on)
        return (np.where(on, np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z, 0)).sum() / on.sum()

    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    grad = model.gradient(x, on, y)
    for name in ("xf", "hf", "cb", "hb", "o"):
        at = tuple(int(i) for i in np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape))
        old, step = model.p[name][at], 1e-3
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 0.02 * abs(grad[name][at]) + 1e-5


def test_labels_of_deep_pages_take_linear_time():
    import time

    from panelyard.llm import htmltext

    page = htmltext.blocks("<article>" + "<div>a" * 4000 + "<div class=comments>b" + "</div>" * 4001 + "</article><p>c")
    began = time.perf_counter()
    y = htmltext.own_labels(page)
    assert time.perf_counter() - began < 0.5 and y.tolist() == [1.0] * 4000 + [0.0, 0.0]


def test_word_sums_equal_single_vectors(monkeypatch):
    import numpy as np

    from panelyard.llm import htmltext

    lines = [["a", "b", "a"], [], ["é" * 50], ["x"] * 9, []]
    single = htmltext._Vectors(htmltext.WORDS, 9)
    want = [np.add.reduce([single[w] for w in x]) if x else np.zeros(htmltext.WORDS) for x in lines]
    for size in (htmltext.HASHED, 2):
        monkeypatch.setattr(htmltext, "HASHED", size)
        assert np.array_equal(htmltext.word_sums(lines), want)
    assert htmltext.word_sums([[], []]).tolist() == [[0.0] * htmltext.WORDS] * 2 and htmltext.word_sums([]).shape == (0, htmltext.WORDS)
