"""The queries of this subpackage, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.spans import remove_repeated_spans

    return remove_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "sentences_removed", "text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.bwt import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.templates import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).drop("text")


def held_out(parts: int) -> Column:
    """Rows whose crc32 of the id as text leaves 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == 2


def op2_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(4))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.ctw import score

    return score(table(spark, sf_dir, "documents"), held_out(7))


def op10_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.iblt import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.transducer import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.infill import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_severity, op2_quality_machine, op3_minhash_near_dedup, op4_mix_sources, op5_repeated_spans,
        op6_html_main_text, op7_context_tree_score, op8_suffix_dedup, op9_template_decontamination, op10_bloom_fingerprints,
        op11_simhash_near_dedup, op12_filter_interaction_audit, op13_fill_in_middle,
    )
}

MIX_SQL = r"""WITH RECURSIVE s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '-11'), 1, 13))::BIGINT h FROM documents),
t AS (SELECT source, sum(size)::BIGINT source_size FROM s GROUP BY 1),
placed AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE weight, row_number() OVER (ORDER BY source IS NULL, encode(source)) place FROM t),
levels AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(3.0::DOUBLE * sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM placed),
goal AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, (source_size / weight, place)) FROM levels WHERE level * weight <= 3.0::DOUBLE * source_size), 'inf'::DOUBLE) * weight) target FROM levels),
plan AS (SELECT *, floor(times) whole, times - floor(times) rest FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END times FROM goal)),
r AS (SELECT s.*, (length(bin(size)) * 4 + CASE WHEN length(bin(size)) > 2 THEN (size >> (length(bin(size)) - 3)) & 3 ELSE 0 END)::INTEGER class, p.source_size, p.target, p.whole, p.rest FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
sizes AS (SELECT source, class, size, count(*) n FROM r WHERE size > 0 AND rest > 0 GROUP BY ALL),
own AS (SELECT *, words / n::DOUBLE mean, row_number() OVER (PARTITION BY source ORDER BY class DESC) k FROM (SELECT source, class, rest, count(*) n, sum(size)::DOUBLE words FROM r WHERE size > 0 AND rest > 0 GROUP BY ALL)),
fold AS (SELECT source, 0::BIGINT k, 0::INTEGER class, 0::BIGINT m, 0.0::DOUBLE rem FROM own WHERE k = 1
    UNION ALL SELECT o.source, o.k, o.class, o.m, o.want - o.m::DOUBLE * o.mean FROM (SELECT o.*, f.rem + rest * words want, least(greatest(floor((f.rem + rest * words) / mean + 0.5::DOUBLE), 0), n)::BIGINT m FROM fold f JOIN own o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1) o),
levels2 AS (SELECT z.*, m - coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT draws, sum(size * n) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE below
    FROM sizes z JOIN fold f ON z.source IS NOT DISTINCT FROM f.source AND z.class = f.class AND f.k > 0 WINDOW w AS (PARTITION BY z.source, z.class ORDER BY size DESC)),
classes AS (SELECT source, class, arg_max(draws::DOUBLE / below, size) factor, arg_max(draws, size) draws FROM levels2 WHERE draws::DOUBLE / below * size < 1 GROUP BY 1, 2),
odds AS (SELECT r.*, c.draws, CASE WHEN rest > 0 AND size > 0 THEN CASE WHEN coalesce(factor * size < 1, FALSE) THEN factor * size ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END chance, (h + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE u
    FROM r LEFT JOIN classes c ON r.source IS NOT DISTINCT FROM c.source AND r.class = c.class),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, class, chance > 0 AND chance < 1 ORDER BY (u / (1 - u)) / (chance / (1 - chance)), doc_id, size) place FROM odds),
done AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN chance = 1 OR (chance > 0 AND place <= draws) THEN 1 ELSE 0 END ELSE 0 END::BIGINT copies FROM ranked)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT taken, copies, chance FROM done"""

AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 100)::INT a, (100 * len(list_distinct(w)) < 80 * len(w))::INT b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT c,
    regexp_matches(t, '[#$%&*|]')::INT d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT e FROM d),
said AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) good, max(coalesce(toxic = 1, false)::INT) toxic FROM labels GROUP BY 1),
cells AS (SELECT part, [a, b, c, d, e] fails, a + b + c + d + e k, count(*) n, coalesce(sum(good), 0) ng, coalesce(sum(toxic), 0) nt FROM f LEFT JOIN said USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x, unnest([1, 2, 3, 4, 5]) i),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x filter_order, [p.i, q.i, r.i, s.i, t.i] ids FROM letter p, letter q, letter r, letter s, letter t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS "filter", ids[step] own, ids[1:step - 1] before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) step)),
seen AS (SELECT *, fails[own] = 1 bad, len(list_filter(before, lambda i: fails[i] = 1)) > 0 gone FROM cells, steps)
SELECT part, filter_order, step::INTEGER step, "filter", coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT removed, coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT redundant,
    coalesce(sum(n) FILTER (bad AND k = 1), 0)::BIGINT unique_fails, coalesce(sum(ng) FILTER (bad AND NOT gone), 0)::BIGINT good_lost, coalesce(sum(nt) FILTER (bad AND NOT gone), 0)::BIGINT toxic_lost,
    (SELECT coalesce(sum(n), 0) FROM seen z WHERE z.part = seen.part AND z.own = seen.own AND z.bad AND NOT z.gone)::BIGINT shapley
FROM seen GROUP BY part, filter_order, step, "filter", own"""

INFILL_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
g AS (SELECT *, len(u) n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) y, ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') plain, ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 spm FROM d),
s AS (SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') prefix, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') middle, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') suffix FROM g)
SELECT doc_id, n::BIGINT n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END form, CASE WHEN NOT plain THEN length(prefix) END::BIGINT prefix_chars, CASE WHEN NOT plain THEN length(middle) END::BIGINT middle_chars,
    sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) output_sha256, sha256(t) restored_sha256 FROM s"""

#: SQL for the operators that it can express at a bearable price; the others have brute-force tests.
ORACLES: dict[str, str] = {"op4_mix_sources": MIX_SQL, "op12_filter_interaction_audit": AUDIT_SQL, "op13_fill_in_middle": INFILL_SQL}
