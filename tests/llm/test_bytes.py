import hashlib
import random

from panelyard.llm.bwt import remove_repeated_bytes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\1" * length
    out = []
    for b, g in zip(data, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((len(b), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (20, 60, 120, 200)]
    texts = [None, "", "a" * 90, "ab" * 300, "x" + "ab" * 300, passage[3], passage[3], passage[3] + "!"]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passage) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 80)))
            cut = r.randint(0, len(p) // 2)
            parts.append(p[cut : len(p) - r.randint(0, len(p) // 3)])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    for length, gram, step in ((80, 41, 8), (60, 31, 10)):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeated_bytes(docs, length=length, gram=gram, step=step).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_same_id_null_id_and_empty(spark):
    docs = spark.createDataFrame([(1, "q" * 500), (1, "z" * 10), (None, None)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in remove_repeated_bytes(docs).collect())
    assert got == [(0, 0, 0), (1, 10, 0), (1, 500, 500)]
    assert remove_repeated_bytes(docs.limit(0)).count() == 0


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    r = random.Random(8)
    words = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(2)]
    short, full = words[0][:399], words[1][:400]
    texts = [f"A{short}B", f"C{short}D", f"E{full}F", f"G{full}H", f"I{full}J", f"K{words[0][400:]}", f"L{words[1]}"]
    assert min(len(short.split()), len(full.split())) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeated_bytes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)
    assert [got[i][1] for i in range(len(texts))] == [0, 0, 400, 400, 400, 0, 400]
    # a string that starts twice in one document, and in no other, goes as well
    once = spark.createDataFrame([(0, f"{full}M{full}N"), (1, f"O{short}P")], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_removed) for x in remove_repeated_bytes(once).collect()) == [(0, 800), (1, 0)]
