"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from topicloom.llm.tokens import digest, read_orc, write_orc

    path = Scratch(spark, "op1").path("tokens.orc")
    write_orc(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return digest(read_orc(spark, path))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.near import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.urls import BLOCK_WORDS, CONTRACT_RULES, url_verdicts, word_rule

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, [*CONTRACT_RULES, *map(word_rule, BLOCK_WORDS)]).select("page_id", "host", "path", "rule", "verdict")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.lines import dedup_passages

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, Scratch(spark, "op5")).select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), Scratch(spark, "op6")).drop("text_key")


def op7_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.vectors import vector_duplicates

    return vector_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op8"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.suffix import dedup_bytes

    rows = dedup_bytes(_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_pack_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from topicloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"), public_tokenizers.path("word_bpe_49k.json"))


def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.conversations import repair_damage

    return repair_damage(_table(spark, sf_dir, "conversations"), Scratch(spark, "op12"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm.manifest import merkle_manifest

    return merkle_manifest(_table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept FROM reach r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP7_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.vec_id GROUP BY r.vec_id"""


def _op4_sql() -> str:
    from topicloom.llm.urls import BLOCK_WORDS

    words = "|".join(BLOCK_WORDS)
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rule, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS k FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path, '(?i)(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM f WHERE k = 1"""


OP6_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, CAST(('0x' || substr(md5('5:' || doc_id), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY source HAVING sum(n_tokens) > 0),
p AS (SELECT source, tokens, docs, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS p FROM s),
goal AS (SELECT -sum(p * ln(p)) + 0.5::DOUBLE * (ln(CAST(count(*) AS DOUBLE)) + sum(p * ln(p))) AS goal FROM p),
bisect AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT k + 1, CASE WHEN even THEN (low + high) / 2 ELSE low END, CASE WHEN even THEN high ELSE (low + high) / 2 END FROM (
    SELECT b.k, b.low, b.high, (SELECT -sum(w * ln(w)) FROM (SELECT pow(p, (b.low + b.high) / 2) / sum(pow(p, (b.low + b.high) / 2)) OVER () AS w FROM p)) > (SELECT goal FROM goal)
      OR (SELECT max(pow(p, (b.low + b.high) / 2 - 1)) / min(pow(p, (b.low + b.high) / 2 - 1)) FROM p) > 4 AS even FROM bisect b WHERE b.k < 40)),
t AS (SELECT round(high, 6) AS t FROM bisect WHERE k = 40),
w AS (SELECT source, tokens, docs, pow(p, t) / sum(pow(p, t)) OVER () AS weight, round(pow(p, t) / p / min(pow(p, t) / p) OVER (), 6) AS passes FROM p, t),
x AS (SELECT d.*, coalesce(w.weight, 0) AS weight, coalesce(w.passes, 1) AS passes, coalesce(w.tokens, 0) AS tokens, CAST(floor(d.u * ceil(coalesce(w.docs, 1) / 1024.0)) AS BIGINT) AS block FROM d LEFT JOIN w ON d.source IS NOT DISTINCT FROM w.source),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY block, u, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 6) AS weight, passes, block, CAST(floor(passes) + CASE WHEN before < (passes - floor(passes)) * tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o"""


OP11_SQL = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5"""


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


OP13_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS t),
marked AS (SELECT d.*, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, crc.t[xor(c, b) % 256 + 1])) AS c FROM documents d, crc),
leaves AS (SELECT doc_id, lang, sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS leaf,
  CASE WHEN coalesce(xor(c, CAST(4294967295 AS BIGINT)) % 7 = 0, false) AND n_chars IS NOT NULL THEN sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars + 1')} || {_field('text')}) END AS claimed FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM leaves),
lev AS (SELECT j, 0 AS level, k, count(*) OVER (PARTITION BY j) AS n, leaf AS h FROM placed UNION ALL SELECT j, level + 1, k // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY k)) FROM lev WHERE n > 1 GROUP BY j, level, n, k // 2),
top AS (SELECT 0 AS level, j AS k, count(*) OVER () AS n, h FROM lev WHERE n = 1 UNION ALL SELECT level + 1, k // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY k)) FROM top WHERE n > 1 GROUP BY level, n, k // 2),
steps AS (SELECT p.j, p.k, 0 AS part, l.level, (p.k >> l.level) % 2 AS right_one, s.h FROM placed p JOIN (SELECT DISTINCT j, level FROM lev WHERE n > 1) l ON p.j = l.j LEFT JOIN lev s ON s.j = p.j AND s.level = l.level AND s.k = xor(p.k >> l.level, 1)
  UNION ALL SELECT p.j, p.k, 1, l.level, (p.j >> l.level) % 2, s.h FROM placed p CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l LEFT JOIN top s ON s.level = l.level AND s.k = xor(p.j >> l.level, 1)),
ways AS (SELECT j, k, list({{'h': h, 'r': right_one}} ORDER BY part, level) AS way, string_agg(h, '' ORDER BY part, level) AS beside FROM steps GROUP BY j, k),
ends AS (SELECT p.*, sha256(coalesce(w.beside, '')) AS proof_sha256, list_reduce(list_prepend({{'h': coalesce(p.claimed, p.leaf), 'r': CAST(0 AS BIGINT)}}, coalesce(w.way, [])), lambda a, s: {{'h': sha256(CASE WHEN s.h IS NULL THEN a.h WHEN s.r = 1 THEN s.h || a.h ELSE a.h || s.h END), 'r': s.r}}).h AS folded_root FROM placed p LEFT JOIN ways w ON w.j = p.j AND w.k = p.k)
SELECT e.doc_id, e.leaf, l.h AS subroot, t.h AS root, e.proof_sha256, e.folded_root, e.folded_root = t.h AS verified FROM ends e JOIN lev l ON l.j = e.j AND l.n = 1 CROSS JOIN (SELECT h FROM top WHERE n = 1) t"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express over whole tables; the others are
    tested against brute force, exact round trips and held-out accuracy."""
    return {"op2_minhash_dedup": OP2_SQL, "op4_url_rules": _op4_sql(), "op6_mix_sources": OP6_SQL, "op7_pq_dedup": OP7_SQL, "op11_pivot_top_k": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
