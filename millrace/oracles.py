"""DuckDB SQL that gives the rows of the queries in `millrace.queries`."""

from __future__ import annotations

from millrace.functions.rolling import MASK, WINDOW, Sizes


def rotl(v: str, k: str) -> str:
    """v rotated left by k (0 to 31) in 32 bits; by 0 apart, since a shift by 32 leaves the type."""
    return f"CASE WHEN {k} = 0 THEN {v} ELSE ((({v}) << ({k})) & {MASK}) | (({v}) >> (32 - ({k}))) END"


def chunk_ctes(sizes: Sizes, begin: int = 0) -> str:
    """CTEs ch(source, doc_id, pos, start, size, id) and cand(doc_id, i): all documents, chunked from byte `begin` on."""
    table = ", ".join(map(str, sizes.table))
    least, most, d = sizes.least, sizes.most, sizes.divisor
    return f"""
  blob AS (SELECT doc_id, source, lang, substr(hex(encode(text)), {2 * begin + 1}) AS h, CAST(greatest(strlen(text) - {begin}, 0) AS BIGINT) AS len FROM documents),
  octet AS (SELECT doc_id, unnest(range(len)) AS i, unnest(regexp_extract_all(h, '..')) AS o FROM blob),
  tab AS (SELECT upper(lpad(to_hex(k), 2, '0')) AS o, v FROM (SELECT unnest(range(256)) AS k, unnest([{table}]) AS v)),
  turned AS (SELECT doc_id, i, {rotl("CAST(v AS BIGINT)", "(32 - i % 32) % 32")} AS u FROM octet JOIN tab USING (o)),
  win AS (SELECT doc_id, i, bit_xor(u) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS x FROM turned),
  cand AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, {rotl("x", "i % 32")} AS hash FROM win WHERE i >= {WINDOW - 1}) WHERE hash % {d} = {d - 1}),
  walk(doc_id, len, pos, start, stop) AS (
    SELECT doc_id, len, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM blob WHERE len > 0
    UNION ALL
    SELECT w.doc_id, w.len, w.pos + 1, w.stop, CASE WHEN w.len - w.stop <= {least} THEN w.len ELSE coalesce(min(c.i) + 1, least(w.len, w.stop + {most})) END
    FROM walk w LEFT JOIN cand c ON c.doc_id = w.doc_id AND c.i >= w.stop + {least} AND c.i < w.stop + {most}
    WHERE w.stop < w.len GROUP BY w.doc_id, w.len, w.pos, w.stop
  ),
  ch AS MATERIALIZED (SELECT b.source, b.lang, w.doc_id, w.pos, w.start + {begin} AS start, w.stop - w.start AS size, sha256(unhex(substr(b.h, CAST(2 * w.start + 1 AS BIGINT), CAST(2 * (w.stop - w.start) AS BIGINT)))) AS id
         FROM walk w JOIN blob b USING (doc_id) WHERE w.pos >= 0)"""


IDX = """
  idx AS MATERIALIZED (SELECT source, row_number() OVER w - 1 AS pos, id, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, size FROM ch WINDOW w AS (PARTITION BY source ORDER BY doc_id, pos))"""

FIRSTS = """
  firsts AS (SELECT source, id, min(pos) AS pos, min_by(size, pos) AS size FROM idx GROUP BY source, id),
  popular AS (SELECT id FROM ch GROUP BY id HAVING count(DISTINCT doc_id) > 1),
  seeded AS (SELECT DISTINCT b.source, a.id FROM (SELECT DISTINCT source, id FROM idx) a JOIN (SELECT DISTINCT source FROM idx) b ON a.source < b.source),
  packed AS (SELECT DISTINCT id, size - size // 3 AS compressed_size FROM ch WHERE id < 'f')"""

RUNS = """
  m AS (SELECT t.source, t.pos, s.source AS seed, s.pos AS seed_pos FROM idx t JOIN idx s ON t.id = s.id AND s.source < t.source),
  il AS (SELECT *, pos - row_number() OVER (PARTITION BY source, seed, seed_pos - pos ORDER BY pos) AS island FROM m),
  ln AS (SELECT source, pos, seed, seed_pos, least(max(pos) OVER (PARTITION BY source, seed, seed_pos - pos, island) - pos + 1, 100) AS n FROM il),
  runs AS (SELECT source, pos, seed, seed_pos, n FROM ln QUALIFY row_number() OVER (PARTITION BY source, pos, seed ORDER BY n DESC, seed_pos) = 1),
  best AS (SELECT r.source, r.pos, r.seed, r.seed_pos, r.n, e.start + e.size - t.start AS bytes FROM runs r JOIN idx t ON t.source = r.source AND t.pos = r.pos JOIN idx e ON e.source = r.source AND e.pos = r.pos + r.n - 1
           QUALIFY row_number() OVER (PARTITION BY r.source, r.pos ORDER BY e.start + e.size - t.start DESC, r.seed) = 1),
  steps AS MATERIALIZED (SELECT t.source, t.pos, coalesce(b.n, 1) AS n, b.seed, b.seed_pos FROM idx t LEFT JOIN best b ON b.source = t.source AND b.pos = t.pos),
  plan(source, first, n, seed, seed_pos) AS (
    SELECT source, pos, n, seed, seed_pos FROM steps WHERE pos = 0
    UNION ALL
    SELECT s.source, s.pos, s.n, s.seed, s.seed_pos FROM plan p JOIN steps s ON s.source = p.source AND s.pos = p.first + p.n
  )"""

NULL_IDX = IDX.replace("AS pos, id,", "AS pos, CASE WHEN id < '1' THEN '0' ELSE id END AS id,")

NULL_RUNS = RUNS.replace("  runs AS (", """  nil AS (SELECT source, pos, pos - row_number() OVER (PARTITION BY source ORDER BY pos) AS island FROM idx WHERE id = '0'),
  runs AS (SELECT source, pos, CAST(NULL AS VARCHAR) AS seed, CAST(-1 AS BIGINT) AS seed_pos, least(max(pos) OVER (PARTITION BY source, island) - pos + 1, 100) AS n FROM nil UNION ALL
           """).replace("DESC, r.seed)", "DESC, r.seed NULLS FIRST)")


def oracles(sizes: Sizes) -> dict[str, str]:
    ch = "WITH RECURSIVE" + chunk_ctes(sizes)
    idx = f"{ch},{IDX}"
    firsts = f"{idx},{FIRSTS}"
    seeds = f"{idx},{RUNS}"

    def info(seed: bool, cache: bool, sizes_known: bool) -> str:
        s = "(s.id IS NOT NULL)" if seed else "false"
        c = "(c.id IS NOT NULL)" if cache else "false"
        k = "p.compressed_size" if sizes_known else "CAST(NULL AS BIGINT)"
        return f"""{firsts},
  u AS (SELECT f.source, f.id, f.size, {s} AS in_seed, {c} AS in_cache, (l.id IS NOT NULL) AS in_store, {k} AS cs FROM firsts f
        LEFT JOIN seeded s ON s.source = f.source AND s.id = f.id LEFT JOIN popular c ON c.id = f.id LEFT JOIN packed p ON p.id = f.id
        LEFT JOIN (SELECT DISTINCT id FROM ch WHERE lang IN ('en', 'de')) l ON l.id = f.id)
SELECT t.source, t.total, t.size, u.* EXCLUDE (source) FROM
  (SELECT source, count(*) AS total, max(start + size) AS size FROM idx GROUP BY source) t JOIN
  (SELECT source, count(*) AS "unique", count_if(in_seed) AS in_seed, count_if(in_cache) AS in_cache, count_if(in_store) AS in_store, count_if(NOT in_seed AND NOT in_cache) AS not_in_seed_nor_cache,
     CAST(coalesce(sum(size) FILTER (NOT in_seed), 0) AS BIGINT) AS dedup_size_not_in_seed, CAST(coalesce(sum(size) FILTER (NOT in_seed AND NOT in_cache), 0) AS BIGINT) AS dedup_size_not_in_seed_nor_cache,
     CAST(CASE WHEN count_if(NOT in_seed AND NOT in_cache AND NOT coalesce(cs > 0, false)) = 0 THEN coalesce(sum(cs) FILTER (NOT in_seed AND NOT in_cache), 0) ELSE 0 END AS BIGINT) AS dedup_size_not_in_seed_nor_cache_compressed
   FROM u GROUP BY source) u USING (source)"""

    url_path = r"regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    escaped = "list_aggregate([CASE WHEN c BETWEEN 33 AND 126 AND c NOT IN (35, 92) THEN chr(c) ELSE '\\' || lpad(CAST(c // 64 AS VARCHAR) || CAST((c // 8) % 8 AS VARCHAR) || CAST(c % 8 AS VARCHAR), 3, '0') END FOR c IN [CAST('0x' || h AS INTEGER) FOR h IN regexp_extract_all(hex(encode(name)), '..')]], 'string_agg', '')"
    return {
        "chunk_boundaries": f"{ch} SELECT doc_id, pos, start, size FROM ch",
        "chunk_index": f"{ch} SELECT doc_id, pos, start, size, id FROM ch",
        "chunk_advance": f"WITH RECURSIVE{chunk_ctes(sizes, 100)} SELECT doc_id, pos, start, size, id FROM ch",
        "index_file_roundtrip": f"{idx} SELECT source AS name, pos, id, start, size FROM idx",
        "archive_roundtrip": "SELECT regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host, 'p' || page_id AS path, CAST(strlen(html) AS BIGINT) AS size, sha256(encode(html)) AS digest FROM pages",
        "chunk_candidates": f"{ch} SELECT b.doc_id, count(c.i) AS n_candidates FROM blob b LEFT JOIN cand c USING (doc_id) GROUP BY b.doc_id",
        "chunk_size_histogram": f"{ch} SELECT size // 64 AS bucket, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS bytes FROM ch GROUP BY 1",
        "dedup_summary": f"{ch} SELECT source, count(*) AS n_chunks, count(DISTINCT id) AS n_distinct, CAST(sum(size) AS BIGINT) AS bytes FROM ch GROUP BY source",
        "index_offsets": f"{idx} SELECT source, pos, id, start, size FROM idx",
        "index_length": f"{idx} SELECT source, max(start + size) AS length, count(*) AS n_chunks FROM idx GROUP BY source",
        "list_chunks": f"{idx} SELECT source, pos, id FROM idx",
        "inspect_chunks": f"{firsts} SELECT i.source, i.pos, i.id, i.start, i.size AS uncompressed_size, coalesce(p.compressed_size, 0) AS compressed_size FROM idx i LEFT JOIN packed p ON p.id = i.id",
        "info_plain": info(False, False, False),
        "info_seed": info(True, False, False),
        "info_cache": info(False, True, False),
        "info_seed_cache": info(True, True, False),
        "info_compressed": info(True, True, True),
        "dedup_store": f"{ch} SELECT id, min(size) AS size FROM ch GROUP BY id",
        "index_names": r"""
            WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages), n AS (SELECT page_id, path, regexp_extract(path, '([^/]*)/?$', 1) AS name FROM p)
            SELECT page_id, name NOT IN ('', '.', '..') AND NOT contains(name, '/') AND NOT contains(name, '\') AS part, path NOT IN ('', '.', '..') AND NOT contains(path, '/') AND NOT contains(path, '\') AS whole FROM n""",
        "get_chunks": f"WITH RECURSIVE {chunk_ctes(sizes)} SELECT id, any_value(size) + CASE WHEN id >= '8' THEN 1 ELSE 0 END AS size, id < '8' AS valid FROM ch WHERE lang <> 'en' GROUP BY id",
        "sparse_state": f"{idx} SELECT source, pos FROM idx WHERE size >= 256",
        "chop_ignore": f"{firsts} SELECT DISTINCT id FROM ch WHERE id NOT IN (SELECT id FROM popular)",
        "cache_copy_plan": f"{firsts} SELECT DISTINCT c.id, c.id IN (SELECT id FROM packed) AS found FROM ch c WHERE c.id NOT IN (SELECT id FROM popular) AND c.id NOT IN (SELECT id FROM ch WHERE lang = 'en')",
        "prune_deleted": f"{firsts} SELECT DISTINCT id FROM ch WHERE id NOT IN (SELECT id FROM ch WHERE lang = 'en')",
        "prune_kept": f"{firsts} SELECT DISTINCT id FROM ch WHERE id IN (SELECT id FROM ch WHERE lang = 'en')",
        "verify_store": f"{ch} SELECT DISTINCT id FROM ch WHERE id >= 'c'",
        "verify_index": f"{ch} SELECT doc_id, pos, start, size, id FROM ch WHERE pos > 0 AND size >= 300",
        "router_lookup": f"{ch} SELECT id, min_by(lang, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 9 END) FILTER (lang IN ('fr', 'de')) AS served FROM ch GROUP BY id",
        "cache_lookup": f"{firsts} SELECT c.id, CASE WHEN c.id IN (SELECT id FROM popular) THEN 'hit' WHEN c.id IN (SELECT id FROM packed) THEN 'fill' ELSE 'missing' END AS outcome FROM (SELECT DISTINCT id FROM ch) c",
        "cache_repair": f"{firsts} SELECT c.id, CASE WHEN c.id IN (SELECT id FROM popular) AND c.id < '8' THEN 'hit' WHEN c.id IN (SELECT id FROM packed) THEN 'fill' ELSE 'missing' END AS outcome FROM (SELECT DISTINCT id FROM ch) c",
        "seed_runs": f"{seeds} SELECT source, pos, seed, seed_pos, n FROM runs",
        "seed_best": f"{seeds} SELECT source, pos, seed, seed_pos, n, bytes FROM best",
        "seed_plan": f"{seeds} SELECT source, first, first + n - 1 AS last, seed, seed_pos FROM plan",
        "seed_plan_null": f"{ch},{NULL_IDX},{NULL_RUNS} SELECT source, first, first + n - 1 AS last, seed, seed_pos FROM plan",
        "self_seed": f"{idx} SELECT source, pos, id FROM idx QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY pos) > 1",
        "extract_stats": f"""{seeds},
  cov AS (SELECT source, unnest(range(first, first + n)) AS pos FROM plan WHERE seed IS NOT NULL),
  cls AS (SELECT i.*, CASE WHEN c.pos IS NOT NULL THEN 'seed' WHEN row_number() OVER (PARTITION BY i.source, i.id ORDER BY i.pos) > 1 THEN 'self' ELSE 'store' END AS kind FROM idx i LEFT JOIN cov c ON c.source = i.source AND c.pos = i.pos)
SELECT source, count(*) AS chunks_total, count_if(kind = 'seed') AS chunks_from_seeds, count_if(kind = 'store') AS chunks_from_store,
  CAST(coalesce(sum(size) FILTER (kind = 'seed'), 0) AS BIGINT) AS bytes_from_seeds, CAST(coalesce(sum(size) FILTER (kind = 'self'), 0) AS BIGINT) AS bytes_from_self,
  CAST(coalesce(sum(size) FILTER (kind = 'store'), 0) AS BIGINT) AS bytes_from_store, CAST(sum(size) AS BIGINT) AS bytes_total FROM cls GROUP BY source""",
        "clone_accounting": f"""{seeds},
  seg AS (SELECT p.source, p.first, t.start AS target, s.start AS src, e.start + e.size - t.start AS length FROM plan p JOIN idx t ON t.source = p.source AND t.pos = p.first
          JOIN idx e ON e.source = p.source AND e.pos = p.first + p.n - 1 JOIN idx s ON s.source = p.seed AND s.pos = p.seed_pos),
  cut AS (SELECT *, CASE WHEN src % 512 = target % 512 THEN greatest(0, CAST(floor((length - (512 - target % 512) % 512) / 512) AS BIGINT) * 512) ELSE 0 END AS cloned FROM seg)
SELECT source, first, target, length, CAST(cloned AS BIGINT) AS cloned, CAST(length - cloned AS BIGINT) AS copied FROM cut""",
        "null_runs": """
WITH blob AS (SELECT item_id, length(text) AS gap, CAST(1 + length(text) // 50 AS BIGINT) AS n FROM benchmark)
SELECT item_id, unnest(range(n)) AS pos, n - unnest(range(n)) AS n FROM blob""",
        "reassemble": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(encode(text)) AS digest FROM documents WHERE strlen(text) > 0",
        "cat_range": "SELECT doc_id, sha256(unhex(substr(hex(encode(text)), 201, 600))) AS digest, least(CAST(strlen(text) AS BIGINT) - 100, 300) AS n_bytes FROM documents WHERE strlen(text) > 100",
        "chunk_range": f"""{idx},
  rg AS (SELECT DISTINCT source, unnest([0, 100, 5000, 70000, 99999999]) AS begin, unnest([0, 300, 4000, 1, 5]) AS length FROM idx),
  f AS (SELECT r.source, r.begin, r.length, min(i.pos) FILTER (i.start + i.size > r.begin) AS a, max(i.pos) FILTER (i.start <= r.begin + r.length - 1) AS b, max(i.pos) AS top FROM rg r JOIN idx i USING (source) GROUP BY ALL)
SELECT source, CAST(begin AS BIGINT) AS begin, CAST(length AS BIGINT) AS length, coalesce(a, CASE WHEN length >= 1 THEN top END) AS first, CASE WHEN length < 1 OR a IS NULL THEN coalesce(a, CASE WHEN length >= 1 THEN top END) ELSE greatest(a, b) END AS last FROM f""",
        "sparse_missing": f"{idx} SELECT source, pos FROM idx WHERE start < 20000 AND start + size > 1000 AND size < 256",
        "mtree_lines": f"""
WITH n AS (SELECT page_id, substr({url_path}, 2) || ' #' AS name, html FROM pages)
SELECT page_id, {escaped} || ' type=file mode=0644 uid=' || page_id % 7 || ' gid=0 size=' || strlen(html) || ' time=' || page_id || '.000000007 sha256digest=' || sha256(encode(html)) AS line FROM n""",
        "path_safety": f"""
SELECT page_id, name NOT IN ('', '.', '..') AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AS safe, NOT starts_with(url, '/') AS confined
FROM (SELECT page_id, url, regexp_extract({url_path}, '([^/]*)/?$', 1) AS name FROM pages)""",
        "mode_convert": """
SELECT o_orderkey, m AS unix_mode, CAST((m & 511) | CASE m & 61440 WHEN 24576 THEN 67108864 WHEN 8192 THEN 69206016 WHEN 16384 THEN 2147483648 WHEN 4096 THEN 33554432 WHEN 40960 THEN 134217728 WHEN 49152 THEN 16777216 ELSE 0 END
  | CASE WHEN m & 2048 <> 0 THEN 8388608 ELSE 0 END | CASE WHEN m & 1024 <> 0 THEN 4194304 ELSE 0 END | CASE WHEN m & 512 <> 0 THEN 1048576 ELSE 0 END AS BIGINT) AS node_mode,
  CAST(CASE WHEN m & 61440 IN (24576, 8192, 16384, 4096, 40960, 49152) THEN m ELSE (m & 4095) | 32768 END AS BIGINT) AS back
FROM (SELECT o_orderkey, CAST((o_orderkey * 7919) % 65536 AS BIGINT) AS m FROM orders)""",
        "chunk_name_parse": f"{ch} SELECT id, substr(id, 1, 4) || '/' || id || '.cacnk' AS name, id AS parsed, CAST(NULL AS VARCHAR) AS other FROM (SELECT DISTINCT id FROM ch)",
        "failover_trace": """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT user_id, event_id, CAST(before % 3 AS BIGINT) AS active, CAST((before + bad) % 3 AS BIGINT) AS next FROM e""",
        "storage_roundtrip": f"{ch} SELECT doc_id, pos, id AS digest, '.cacnk.aes-256-gcm-' || substr(sha256(unhex('{'07' * 32}')), 1, 8) AS ext FROM ch",
    }
