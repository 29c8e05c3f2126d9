import hashlib
import random

from pyspark.sql import functions as F

from panelyard.llm import iblt


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(4)
    line = [" ".join(r.choice(["é", "ab", "c.", "dd!"]) for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts = [None, "", "\n", "one", "one", "x y. " * 200]
    texts += ["\n".join(r.choice(line) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts.append("\n".join(f"{k} line" for k in range(900)))
    texts.append("\n".join(f"{k} line" for k in range(450, 1350)))
    ids = sorted(r.sample(range(10**6), len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {x.doc_id: x for x in iblt.fingerprints(docs.repartition(5), ranges=7).collect()}
    assert len(got) == len(texts)

    edited = []
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        edited.append(t[: len(t) - q] + nxt[:q])
    both = [(k, t) for k, t in enumerate([*texts, *edited])]
    d = {x.k: x.d for x in spark.createDataFrame(both, "k int, text string").select("k", iblt.digests(F.col("text")).alias("d")).collect()}

    def jaccard(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    n = len(texts)
    for k, i in enumerate(ids):
        g = got[i]
        assert g.n_chars == len(texts[k] or "")
        assert g.edited_sha256 == hashlib.sha256(edited[k].encode()).hexdigest()
        assert abs(g.near_edited - jaccard(d[k], d[n + k])) < 1e-12
        assert abs(g.near_next - jaccard(d[k], d[(k + 1) % n])) < 1e-12
    assert got[ids[3]].fingerprint == got[ids[4]].fingerprint and got[ids[3]].near_next == 1.0
    assert len({got[i].fingerprint for i in ids[5:]}) > 50


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (1, None)], "doc_id long, text string")
    got = iblt.fingerprints(docs, ranges=3).collect()
    assert sorted((x.doc_id or 9, x.near_next) for x in got) == [(1, 0.0), (3, 0.0), (3, 1.0), (9, 0.0)]
    assert iblt.fingerprints(docs.limit(1), ranges=2).first().near_next == 1.0
    many = [(7, f"t{k}") for k in range(40)] + [(None, f"n{k}") for k in range(40)] + [(k, f"x{k}") for k in range(20)]
    wide = spark.createDataFrame([(i, t, "d", 5) for i, t in many], "doc_id long, text string, d string, range int")
    for table in (wide, wide.withColumn("doc_id", F.col("doc_id").cast("string"))):
        led = iblt.with_next(table.select("doc_id", "text", F.xxhash64("text").alias("h"), F.array(F.lit(1)).alias("d")), 16).select("text", "next_text").collect()
        follow = {x.text: x.next_text for x in led}
        assert len(led) == len(many) and sorted(follow.values()) == sorted(follow)
        h = {x.text: x.h for x in table.select("text", F.xxhash64("text").alias("h")).collect()}
        named = (lambda i: str(i)) if table is not wide else (lambda i: i)
        line = sorted(many, key=lambda x: (x[0] is None, named(x[0]) if x[0] is not None else named(0), h[x[1]]))
        assert all(follow[line[k][1]] == line[(k + 1) % len(line)][1] for k in range(len(line)))
    assert iblt.fingerprints(docs.limit(0), ranges=2).count() == 0
