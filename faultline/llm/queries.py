"""Registered queries of the subpackage and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import caps, centroids, exact, licenses, lm, mixing, ngram_join, packing, periodic, quality, rules, secrets, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_kernel")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    judged, _ = rules.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return judged.drop("rule")


@query(
    "op6_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return exact.assign_in_batches(_table(spark, sf, "documents"))


@query(
    "op8_source_mix",
    r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:10])::BIGINT AS spot
      FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
      2 * source_size AS cap FROM s),
    v AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(weight) OVER () AS everything,
      coalesce(sum(cap) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS taken_weight FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, max((goal - capped::DOUBLE) / (everything - taken_weight)) OVER () AS level FROM v),
    t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM l),
    c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS copies FROM t),
    r AS (SELECT *, target - copies * source_size AS rest FROM c),
    h AS (SELECT source, spot, sum(size)::BIGINT AS bar,
      sum(sum(size)) OVER (PARTITION BY source ORDER BY spot)::BIGINT AS upto FROM d GROUP BY source, spot),
    e AS (SELECT h.source, h.spot, CASE WHEN upto <= rest THEN 1 WHEN upto - bar > rest THEN 0
      WHEN 2 * (rest - (upto - bar)) > bar THEN 1 ELSE 0 END AS more
      FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
      (size * (copies + CASE WHEN copies < 2 THEN more ELSE 0 END))::BIGINT AS taken
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.spot = e.spot
    """,
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.take(_table(spark, sf, "documents"))


@query("op9_length_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _secret_sql() -> str:
    """Every rule's pattern over every text, without an index."""
    hits = " UNION ALL ".join(
        f"SELECT row, doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, p) AS gaps, "
        f"regexp_extract_all(text, p, 1) AS found, regexp_extract_all(text, p, {rule.group}) AS tested "
        f"FROM d, (SELECT '{rule.pattern.replace(chr(39), chr(39) * 2)}' AS p)"
        for number, rule in enumerate(secrets.RULES)
    )
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.BASE_RULES)
    zeros = ", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secrets.BASE_RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    h AS ({hits}),
    u AS (SELECT row, number, kind, least, unnest(gaps[:len(found)]) AS gap, unnest(found) AS own, unnest(tested) AS test,
      unnest(range(len(found))) AS i FROM h WHERE len(found) > 0),
    s AS (SELECT row, number, kind, length(test) >= least AS good, length(own) AS size,
      sum(length(gap) + length(own)) OVER (PARTITION BY row, number ORDER BY i)::BIGINT AS stop FROM u),
    k AS (SELECT row, number, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM s WHERE good),
    g AS (SELECT row, {counts}, string_agg(span, ',' ORDER BY start, number) AS spans,
      coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < {base}), '') AS base FROM k GROUP BY row)
    SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
    """


@query("op10_secret_trigrams", _secret_sql())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(_table(spark, sf, "documents"))


@query("op7_toxicity_grammar")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query("op5_ngram_join")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf, "documents"))


@query("op2_recurrent_lm")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score(_table(spark, sf, "documents"))


@query("op3_license_patience")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_table(spark, sf, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.digest(_table(spark, sf, "documents"))


def _centroid_sql() -> str:
    """Every distance of every round."""
    steps = [
        f"""
        v AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM (
          SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMENSIONS})),
        x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
        f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{centroids.SEED}' || vec_id)) - 1 AS k FROM v QUALIFY k < {centroids.CLUSTERS}),
        c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN x USING (r))"""
    ]
    for t in range(centroids.ROUNDS + 1):
        steps.append(
            f"""
        a{t} AS MATERIALIZED (SELECT r, c.k, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{t} AS c USING (i) GROUP BY r, c.k
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.k) = 1)"""
        )
        if t < centroids.ROUNDS:
            steps.append(
                f"""
        s{t} AS MATERIALIZED (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY k, i),
        c{t + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x
          FROM c{t} AS c LEFT JOIN s{t} AS s ON c.k = s.k AND c.i = s.i)"""
            )
    last = centroids.ROUNDS
    return f"""
    WITH {", ".join(steps)},
    h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
    SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
      centroid_sha256
    FROM a{last} JOIN v USING (r) JOIN h USING (k)
    """


@query("op12_centroid_clusters", _centroid_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.report(_table(spark, sf, "embeddings"))


@query(
    "op13_cap_filters",
    f"""
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: isfinite(x))) = len(v)
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
    e AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM g AS a JOIN g AS b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= {caps.THRESHOLD}),
    t(r, other) AS (SELECT r, r FROM v UNION SELECT t.r, e.b FROM t JOIN e ON t.other = e.a),
    c AS (SELECT t.r, min(v.vec_id) AS component_id FROM t JOIN v ON t.other = v.r GROUP BY t.r),
    n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM v JOIN c USING (r) LEFT JOIN n USING (r)
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return caps.near_copies(_table(spark, sf, "embeddings"))
