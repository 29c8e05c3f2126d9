import random
import re
from collections import defaultdict

from panelyard.llm.minhash import near_duplicates
from panelyard.llm.mixing import mix


def components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(3))
    texts = [None, "", "One", "one", "one two", "One  two", " \t\n", "a b c", "A b c", "a b c d"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(8, 90))]
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t[r.randint(0, 2) :]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bands string")
    for width, percent in ((3, 85), (5, 80)):
        got = {x.doc_id: x for x in near_duplicates(docs, width=width, percent=percent).collect()}
        assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == components(texts, width, percent)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_near_duplicates_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A B C")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in near_duplicates(docs).collect())
    assert got == [(0, 0, True), (2, 2, True), (4, 2, False), (4, 2, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        source = r.choice([None, "a", "b", "b", "b", "b", "b", "ü", "z"]) if i < 2990 else "tiny"
        rows.append((i, "w " * int(r.lognormvariate(3, 1)), source, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {x[0]: x for x in rows}
    for g in got:
        s = by_id[g.doc_id][2]
        size[s] += g.size
        taken[s] += g.taken
        target[s] = g.target
        assert g.taken <= 3 * g.size and (g.size == 0 or g.taken % g.size == 0)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, open_, total = {}, set(names), sum(size.values())
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    longest = max(g.size for g in got)
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * total
        assert abs(taken[s] - want[s]) <= longest
    assert sorted(map(tuple, mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_mix_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "a b", "a"), (1, "a b", "a")], "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == 4 and {x.source_size for x in got} == {0, 4}
    assert mix(docs.limit(0)).count() == 0


def cut_family(r, n, cuts, words=602):
    """One text and n - 1 copies of it with a few runs of ten words cut out: near the text, far from each other."""
    base = [f"w{i}" for i in range(words)]
    texts = [" ".join(base)]
    while len(texts) < n:
        gone = {k for _ in range(cuts) for s in [r.randrange(words - 10)] for k in range(s, s + 10)}
        texts.append(" ".join(w for k, w in enumerate(base) if k not in gone))
    return texts


def test_families_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """All members miss the threshold with the centre: what is told is at most an edge a member, and components are right."""
    from panelyard.llm import minhash

    r = random.Random(12)
    told = []
    left_open = minhash._left_open

    def counted(*args):
        pairs, edges, groups = left_open(*args)
        pairs, edges = minhash.staged(pairs), minhash.staged(edges)
        told.append((pairs.count(), edges.count()))
        return pairs, edges, groups

    monkeypatch.setattr(minhash, "_left_open", counted)
    for n, block in ((60, 256), (120, 16)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        # some members differ from another by little more than a cut
        texts = cut_family(r, n, 8)
        texts += [" ".join(t.split()[: -(k + 1)]) for k, t in enumerate(texts[1 : n // 4])]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        told.clear()
        got = {x.doc_id: x for x in near_duplicates(docs, width=3, percent=85).collect()}
        assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == components(texts, 3, 85)
        blocks = -(-len(texts) // block)
        assert sum(e for _, e in told) <= len(told) * len(texts) * max(blocks, 1)
        assert sum(p for p, _ in told) <= 128 * len(texts)


def test_recall_on_a_planted_corpus(spark):
    """Copies at similarities from 0.6 to 1 among unrelated texts: every link at or above the threshold is found."""
    r = random.Random(20)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(30, 250))]
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = {x.doc_id: x.component_id for x in near_duplicates(docs, width=width, percent=percent).collect()}
        assert [got[i] for i in range(len(texts))] == [c for _, c in components(texts, width, percent)]


def test_shingles_outside_the_centre_stay_in_arrays(spark, monkeypatch):
    """No row for each shingle that a member has beyond the centre: parts of a group count them in arrays, and only what can matter becomes rows."""
    from panelyard.llm import minhash

    r = random.Random(17)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(90):
        t = list(base)
        for k in r.sample(range(5, 200, 16), r.randint(5, 7)):
            t[k] = f"v{r.randrange(2)}"
        texts.append(" ".join(t))
    seen, exploded, inner = [], [], minhash.staged

    def staged(df):
        exploded.append("explode(added" in df._jdf.queryExecution().analyzed().toString())
        out = inner(df)
        if df.columns == ["list", "x", "comp", "linked"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(minhash, "staged", staged)
    monkeypatch.setattr(minhash, "PART", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(docs, width=5, percent=80).collect()}
    want = components(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == want and 1 < len({c for _, c in want}) < 80
    assert sum(seen) and not any(exploded)


def test_shared_alternatives_do_not_multiply(spark, monkeypatch):
    """A family in which many members share each change: what meets is bounded by members times blocks, and no list starts another round; lists of a very wide group give the same."""
    from panelyard.llm import minhash

    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    spots = r.sample(range(120), 30)
    texts = []
    for _ in range(400):
        t = list(base)
        for k in r.sample(spots, r.randint(2, 8)):
            t[k] = f"v{r.randrange(2)}"
        texts.append(" ".join(t))
    rows, rounds, inner, left_open = [], [], minhash.staged, minhash._left_open

    def staged(df):
        out = inner(df)
        if df.columns == ["list", "x", "comp", "linked"]:
            rows.append((out.count(), out.select("list", "x").distinct().count()))
        return out

    monkeypatch.setattr(minhash, "staged", staged)
    monkeypatch.setattr(minhash, "_left_open", lambda *args: rounds.append(1) or left_open(*args))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(texts, 5, 80)
    assert 1 < len({c for _, c in want}) < 300
    for wide in (64, 0):
        monkeypatch.setattr(minhash, "WIDE", wide, raising=False)
        rows.clear(), rounds.clear()
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(docs, width=5, percent=80).collect()}
        assert [got[i] for i in range(len(texts))] == want
        if wide:
            assert len(rounds) == 1 and len(rows) == 1 and rows[0][0] <= 48 * len(texts)
