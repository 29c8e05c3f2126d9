"""The filter audit, fill-in-middle and SimHash near-duplicates against plain Python and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash

from panelyard.llm import infill, queries, simhash, transducer

WORD = re.compile("[^\x20\x09-\x0d]+")
HARD = ["", "a", " ", "\n", "\n\n", "Ä é 中文 \U0001f600", "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y", "A#B", "tab\tand\x0bvt\x0cff\rcr", "\x85 \xa0  ", "%", "one\ntwo", "one\ntwo\n", "É\nÉÉ\n\nz"]


def some_texts(seed, n):
    r = random.Random(seed)
    bits = ["the", "The", "Ä", "中文", "\n", " ", "\t", "#", "ab" * 40, "q", "\U0001f600", "X", "line\n", "12"]
    return HARD + ["".join(r.choice(bits) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 300))) for _ in range(n)]


# -- filter audit ---------------------------------------------------------------------------


def facts(t):
    w = WORD.findall(t)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def test_one_pass_counts_what_patterns_count():
    for seed in range(5):
        texts = some_texts(seed, 60)
        assert transducer.measure(*packed(texts)).tolist() == [facts(t) for t in texts]
    assert transducer.measure(*packed([""])).tolist() == [[0] * 5]


def test_words_of_equal_hashes_stay_apart():
    texts = ["a b c a", "b b", "long" * 30 + " " + "gnol" * 30 + " " + "long" * 30]
    data, _ = packed(texts)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20]+", b" ".join(t.encode() for t in texts))]
    data = np.frombuffer(b" ".join(t.encode() for t in texts) + bytes(8), np.uint8)
    start, stop = np.array(spans).T
    owner = np.array([0] * 4 + [1] * 2 + [2] * 3)
    same = np.zeros(len(start), np.uint64)
    assert transducer.distinct_spans(data, start, stop - start, owner, 3, same).tolist() == [3, 1, 2]


def audited(rows, labels):
    fails = []
    for i, _, t in rows:
        w, d, c, p, s = facts(t or "")
        fails.append({f for f, bad in zip("ABCDE", (w < 100, 100 * d < 80 * w, 100 * c > 10 * p, s > 0, i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, _, u in rows)), strict=True) if bad})
    out, shapley = {}, Counter()
    for part in {p or "" for _, p, _ in rows}:
        own = [(i, f) for (i, p, _), f in zip(rows, fails, strict=True) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [i for i, x in own if f in x and not x & before]
                shapley[part, f] += len(here)
                out[part, order, k + 1] = [
                    f, sum(not x & (before | {f}) for _, x in own), len(here), sum(f in x and bool(x & before) for _, x in own), sum(x == {f} for _, x in own),
                    sum(labels.get(i, (0, 0))[0] for i in here), sum(labels.get(i, (0, 0))[1] for i in here),
                ]
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    r = random.Random(5)
    texts = [*some_texts(9, 30), None, " ".join(f"w{i}" for i in range(120)), "Ab " * 130]
    rows = [(i, r.choice(["en", "de", None, ""]), r.choice(texts)) for i in range(150)] + [(3, "en", "a"), (3, "en", "a"), (None, "de", "a"), (None, None, None)]
    labels = {i: (r.randint(0, 1), r.randint(0, 1)) for i in range(0, 150, 3)}
    docs = spark.createDataFrame([(*x, 1, b"") for x in rows], "doc_id long, lang string, text string, mask int, digest binary")
    said = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(0, 0, 0), (None, 1, 1), (1000, 1, 1)], "doc_id long, quality long, toxic long")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in transducer.audit(docs, said).collect()}
    assert got == audited(rows, labels)
    assert transducer.audit(docs.limit(0), said).count() == 0


# -- fill-in-middle -------------------------------------------------------------------------


def cut(text, doc_id):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_python(spark):
    texts = [*some_texts(2, 80), "has <S> in it\nx", "<P", "<\nS>\n<M\n>", "a<P\n", "end<", "long\n" * 60_000, "é" * 300_000, "\n" * 70]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame([*rows, (-7, None, "x", 5)], "doc_id long, text string, output string, n int")
    got = {x.doc_id: x for x in infill.fill_in_middle(docs).collect()}
    for i, t, *_ in rows:
        assert tuple(got[i])[1:] == cut(t, i)
    assert tuple(got[-7])[1:] == (0, "plain", None, None, "")
    sums = {x.doc_id: x for x in infill.digests(docs).collect()}
    assert all(sums[i].restored_sha256 == hashlib.sha256(t.encode()).hexdigest() and sums[i].output_sha256 == hashlib.sha256(got[i].output.encode()).hexdigest() for i, t, *_ in rows)
    assert {x.form for x in got.values()} == {"plain", "psm", "spm"}
    assert infill.digests(docs.limit(0)).count() == 0
    assert [tuple(x)[1:3] for x in infill.fill_in_middle(docs.selectExpr("cast(null as string) doc_id", "'a\nb' text").limit(1)).collect()] == [(2, cut("a\nb", "")[1])]


def test_unit_ends_in_every_place():
    for n in range(1, 40):
        for text in (b"\n" * n, b"x" * n, b"x" * (n - 1) + b"\n", b"\x0b\n\x8a\x09" * n):
            e = infill.Ends(text)
            places = [k + 1 for k, c in enumerate(text) if c == 10]
            assert [e.end(k + 1) for k in range(e.fed)] == places and e.end(e.units) == n * len(text) // n and e.end(0) == 0


@pytest.mark.parametrize("name", ["op12_filter_interaction_audit", "op13_fill_in_middle"])
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


# -- SimHash --------------------------------------------------------------------------------


def print_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest place reachable over at most 3 differing bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.randint(1, 400))) for _ in range(12)]
    texts = [None, "", " \n", "One", "one", "one two", "One\ttwo", *HARD]
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "new" + str(r.randint(0, 3))
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, print int, root string")
    got = {x.doc_id: x for x in simhash.near_duplicates(docs).collect()}
    prints = [print_of(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == components(prints)
    assert len(set(components(prints))) < len(texts) - 20


def test_simhash_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "A b c"), (2, "A B C"), (4, "q"), (9, None)], "doc_id long, text string")
    got = Counter((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect())
    assert got == Counter({(None, None): 1, (4, 2): 2, (2, 2): 1, (4, 4): 1, (9, 9): 1})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == whole == print_of(text)


def test_positions_cover_every_pair():
    for k in range(1, 6):
        sets = set(simhash.position_sets(k))
        for other in simhash.combinations(range(8), 3):
            assert tuple(p for p in range(8) if p not in other)[:k] in sets


@pytest.mark.parametrize(("most", "blocks"), [(1024, 128), (4, 1000), (4, 1)])
def test_lists_of_any_length_lose_no_link(spark, most, blocks):
    r = random.Random(most + blocks)
    prints = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        # a chain of steps of up to 3 bits, and members around it
        for _ in range(60):
            x = centre
            for _ in range(r.randint(1, 7)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
            y = x
            for _ in range(3):
                y ^= 1 << r.randrange(40, 64)
            prints.add(y)
    prints = sorted(prints)
    want = components(prints)
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    found = simhash.edges(spark.createDataFrame([(sign(p),) for p in prints], "print long"), most, blocks).distinct().collect()
    place = {sign(p): i for i, p in enumerate(prints)}
    near = defaultdict(set)
    for e in found:
        near[place[e.a]].add(place[e.b])
        near[place[e.b]].add(place[e.a])
    got, low = [None] * len(prints), 0
    for i in range(len(prints)):
        if got[i] is None:
            todo = [i]
            while todo:
                k = todo.pop()
                if got[k] is None:
                    got[k] = i
                    todo += near[k]
    assert got == want
