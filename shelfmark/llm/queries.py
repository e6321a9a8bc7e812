"""The corpus operators as queries over the test tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, fixity, html, neardup, packing, pfor, pii, quality, replay, secrets, sharding, substrings
from .common import table


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica with every 97th page's first character altered and every 211th page's record lost."""
    payload = F.when(F.col("page_id") % 97 == 11, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    return fixity.audit(table(spark, sf_dir, "pages"), (payload, F.coalesce(F.col("page_id") % 211 == 5, F.lit(False))))


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.binary_output(table(spark, sf_dir, "documents"))


def op7_tag_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op11_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op12_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_fixity, op2_cgk_decontamination, op3_feistel_shards, op4_decision_list, op5_bucket_refinement, op6_pfor_tokens, op7_tag_ratio_text, op8_lsh_forest, op9_shortest_pack,
        op10_weak_pii, op11_grammar_secrets, op12_filter_replay, op13_hamerly_clusters,
    )  # fmt: skip
}

def _clusters_sql(clusters: int = 40, rounds: int = 5, width: int = 64) -> str:
    """One common table an assignment (a) and one a set of centroids (c)."""
    parts = [
        f"k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, v FROM k QUALIFY c < {clusters})",
    ]
    for i in range(rounds + 1):
        d = "CAST(list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(k.v) AS v, min(struct_pack(d := {d}, c := c)) AS best FROM k, c{i} c GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT best.c AS c, j, CAST(sum(CAST(v[j] AS BIGINT)) // count(*) - (sum(CAST(v[j] AS BIGINT)) < 0 AND sum(CAST(v[j] AS BIGINT)) % count(*) <> 0)::INT AS DOUBLE) AS x FROM a{i}, range(1, {width + 1}) t(j) GROUP BY 1, 2)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(any_value(n.v), any_value(o.v)) AS v FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS v FROM s{i} GROUP BY c) n USING (c) GROUP BY o.c)")
    return f"""WITH {', '.join(parts)},
facts AS (SELECT best.c AS c, sum(best.d) AS s FROM a{rounds} GROUP BY 1)
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(f.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM facts) AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN facts f ON f.c = best.c JOIN c{rounds} c ON c.c = best.c"""


ORACLES = {
    "op12_filter_replay": r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, list_transform(range(1, step), lambda i: substr(filter_order, i, 1)) AS before FROM orders, range(1, 6) t(step)),
rows AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, fails[filter] AS here, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, n, good, toxic FROM docs, steps),
sums AS (
  SELECT part, filter_order, step, filter, count(*) FILTER (NOT gone AND NOT here) AS kept, count(*) FILTER (here AND NOT gone) AS removed, count(*) FILTER (here AND gone) AS redundant,
    count(*) FILTER (here AND n = 1) AS unique_fails, count(*) FILTER (here AND NOT gone AND good) AS good_lost, count(*) FILTER (here AND NOT gone AND toxic) AS toxic_lost FROM rows GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM sums""",
    "op13_hamerly_clusters": _clusters_sql(),
    "op1_warc_fixity": r"""
WITH r AS (
  SELECT page_id, 'part-' || lpad(CAST(coalesce(page_id // 1024, -1) AS VARCHAR), 10, '0') || '.warc' AS file,
    concat(e'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ', coalesce(url, ''), e'\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: ',
           CAST(strlen(coalesce(html, '')) AS VARCHAR), e'\r\n\r\n', coalesce(html, ''), e'\r\n\r\n') AS record
  FROM pages),
s AS (SELECT page_id, file, CAST(strlen(record) AS BIGINT) AS n_bytes, sha256(record) AS sha256 FROM r)
SELECT page_id, file, CAST(sum(n_bytes) OVER (PARTITION BY file ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS warc_offset, n_bytes, sha256,
  CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 97 = 11 THEN 'altered' ELSE 'intact' END AS verdict
FROM s""",
    "op5_bucket_refinement": r"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT doc_id, k, substr(h, 512 * k + 1, 610) AS c FROM t, LATERAL (SELECT unnest(range(0, (n + 255) // 256)) AS k)),
w AS (SELECT doc_id, 256 * k + i AS s, unhex(substr(c, 2 * i + 1, 100)) AS b FROM cut, LATERAL (SELECT unnest(range(0, least(256, length(c) // 2 - 49))) AS i)),
least_id AS (SELECT b, min(doc_id) AS first FROM w GROUP BY b HAVING count(*) > 1),
gone AS (SELECT w.doc_id, w.s FROM w JOIN least_id l ON w.b = l.b AND l.first < w.doc_id),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS opens FROM gone),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
sums AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS bytes FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, n, n FROM t),
pieces AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) AS since FROM edges),
kept AS (SELECT p.doc_id, string_agg(substr(t.h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS h FROM pieces p JOIN t ON p.doc_id = t.doc_id GROUP BY p.doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM t LEFT JOIN sums ON t.doc_id = sums.doc_id JOIN kept ON t.doc_id = kept.doc_id""",
    "op8_lsh_forest": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
members AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS c FROM sets),
classes AS (SELECT c, s, n FROM members WHERE doc_id = c),
shingles AS (SELECT c, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.c AS p, b.c AS q FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT c AS p, c AS q FROM classes WHERE n > 0 UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
components AS (SELECT p AS c, min(q) AS component_id FROM reach GROUP BY p)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, CAST(coalesce(k.component_id, m.doc_id) AS BIGINT) AS component_id, m.doc_id = coalesce(k.component_id, m.doc_id) AS kept
FROM members m LEFT JOIN components k ON m.c = k.c""",
}
