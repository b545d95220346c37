"""The queries of this subpackage, each an operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import contamination, linetemplates, nearest, packing, privacy, quality, simhash, tokens, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_rounds(name: str, shares: bool, rounds: int = 20, damping: float = 0.85) -> str:
    """CTEs name0, name1, ...: trust and distrust round by round, as urls.propagated computes them."""
    gives, takes = ("n / inn", "n / o") if shares else ("n / o", "n / inn")
    out = [f"{name}0 AS (SELECT host, good, bad, good * {1 - damping} AS trust, bad * {1 - damping} AS distrust FROM seeds)"]
    for k in range(rounds):
        sums = f"SELECT dst AS host, trust * {gives} AS t, 0.0 AS d FROM edges JOIN {name}{k} ON src = host UNION ALL SELECT src, 0.0, distrust * {takes} FROM edges JOIN {name}{k} ON dst = host"
        sums = f"SELECT host, sum(t) * {damping} AS t, sum(d) * {damping} AS d FROM ({sums}) GROUP BY host"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT host, good, bad, good * {1 - damping} + coalesce(t, 0.0) AS trust, bad * {1 - damping} + coalesce(d, 0.0) AS distrust FROM {name}{k} LEFT JOIN ({sums}) USING (host))")
    return ",\n".join(out)


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
HREF_SQL = urls.HREF.replace("*+", "*").replace("]++", "]+").replace("'", "''")
OP2_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, html, {LOWER_SQL.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, pre) AS (VALUES {RULES_SQL}),
f AS (SELECT r, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY r),
q AS (SELECT p.*, rule, verdict FROM p LEFT JOIN f USING (r)),
hosts AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM q WHERE host <> '' GROUP BY host),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {LOWER_SQL.format("d")} AS dst
  FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{HREF_SQL}', 1))) AS d FROM p)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS (SELECT src, dst, n, sum(n) OVER (PARTITION BY src) AS o, sum(n) OVER (PARTITION BY dst) AS inn FROM l),
seeds AS (SELECT host, max(good) AS good, max(bad) AS bad FROM (SELECT * FROM hosts UNION ALL SELECT src, 0.0, 0.0 FROM edges UNION ALL SELECT dst, 0.0, 0.0 FROM edges) GROUP BY host),
{op2_rounds("x", False)},
{op2_rounds("y", True)}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN y20.distrust >= 0.1 AND x20.distrust > x20.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN x20 USING (host) LEFT JOIN y20 USING (host)
"""


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(privacy.personal_data(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids_written(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digests(packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json"))))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.verdicts(contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("text_hash")


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, k, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, n, k, item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetemplates.without_recurring_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_urls": op2_urls,
    "op3_privacy": op3_privacy,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_token_ids": op6_token_ids,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_line_templates": op9_line_templates,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op1_top_k": OP1_SQL, "op2_urls": OP2_SQL, "op8_decontamination": OP8_SQL}
