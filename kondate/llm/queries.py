"""The registered queries of the operators: each runs one over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate.llm import ann, chat, exact_dedup, langid, merkle, mixing, ngram_join, packing, pii, sharding, url_filter, warc, whitening
from kondate.llm.common import read


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_decisions(read(spark, sf_dir, "documents"), 0.5)


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 24)


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(pii.find_personal_data(read(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), 4096, 1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_corpus(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read(spark, sf_dir, "documents"), 3, 90)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), 10, 100)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_documents(read(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_digests(read(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read(spark, sf_dir, "embeddings"))


def llm_shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the key decides in op3: the shard, and the shard with one more."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 24).select("doc_id", "size", "shard", "grown_shard")


def llm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors of op4 find in each document."""
    return pii.find_base(read(spark, sf_dir, "documents")).select("doc_id", *pii.kind_counts())


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 reads of each url, and the rule that fits it."""
    url = F.col("url")
    parts = read(spark, sf_dir, "pages").select("page_id", url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    return parts.select("page_id", "host", "path", url_filter.rule_of(F.col("host"), F.col("path"), url_filter.RULES)["rule"].alias("rule"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc_reassembly, op2_raked_mixture, op3_jump_sharding, op4_pii_disclosure, op5_exact_dedup, op6_best_fit_packing, op7_language_id, op8_ngram_jaccard, op9_nearest_neighbours, op10_url_filter, op11_merkle_manifest, op12_chat_format, op13_whitening, llm_shard_law, llm_base_counts, llm_url_rules]
    return {f.__name__: f for f in found}


OP5 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
q AS (SELECT *, CASE WHEN strlen(body) >= 100 AND page_id <> least THEN least END AS refers_to FROM p)
SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, CAST(NULL AS VARCHAR) AS problem
FROM q
"""
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""


_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str = "text") -> str:
    return "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _grown(name: str, leaves: str) -> str:
    """All levels of the trees over leaves (tree, idx, h), and the runs of eight of each level."""
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 8),
{name}_runs AS (SELECT tree, lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _folded(name: str, runs: str, start: str) -> str:
    """From rows (k, tree, idx, node, proof) up to the root, run by run."""
    return f"""{name} AS (
  SELECT k, tree, 0 AS lvl, idx, node, proof FROM {start}
  UNION ALL SELECT p.k, p.tree, p.lvl + 1, p.idx // 8, sha256(array_to_string(hs[1:p.idx % 8], '') || p.node || array_to_string(hs[p.idx % 8 + 2:], '')), p.proof || array_to_string(hs[1:p.idx % 8], '') || array_to_string(hs[p.idx % 8 + 2:], '')
    FROM {name} p JOIN {runs} r ON r.tree = p.tree AND r.lvl = p.lvl AND r.run = p.idx // 8)"""


OP11 = f"""
WITH RECURSIVE bytes AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql()} AS leaf, {_leaf_sql(_LOWER)} AS lowered,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 AS touched
  FROM documents, bytes),
leaves AS (SELECT doc_id AS k, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, leaf AS h, CASE WHEN touched THEN lowered ELSE leaf END AS node FROM d),
{_grown("nodes", "leaves")},
roots AS (SELECT tree AS k, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, h FROM nodes WHERE n = 1),
{_grown("tops", "roots")},
{_folded("ups", "nodes_runs", "(SELECT k, tree, idx, node, '' AS proof FROM leaves)")},
lower AS (SELECT k, tree, node, proof FROM ups QUALIFY row_number() OVER (PARTITION BY k ORDER BY lvl DESC) = 1),
{_folded("overs", "tops_runs", "(SELECT l.k, r.tree, r.idx, l.node, l.proof FROM lower l JOIN roots r ON r.k = l.tree)")},
upper AS (SELECT k, node, proof FROM overs QUALIFY row_number() OVER (PARTITION BY k ORDER BY lvl DESC) = 1)
SELECT l.k AS doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN roots s ON s.k = l.tree JOIN upper u ON u.k = l.k
"""
OP12 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
m AS (SELECT *, len(regexp_extract_all(text, '<␛*/?s>|\[␛*/?INST\]|<␛*</?SYS>>|<␛*\|(role|says|end|image|audio|document|/document|other)\|>')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || e'\n' || text || e'\n', '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + marks + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 24 + length(role) END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


SHARD_LAW = f"""
WITH RECURSIVE walk AS (
  SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k, 0::BIGINT AS jump FROM documents
  UNION ALL SELECT doc_id, n, floor((jump + 1) * (2147483648.0::DOUBLE / ((n // 8589934592)::DOUBLE + 1)))::BIGINT FROM (SELECT doc_id, jump, (k * {sharding.MULTIPLIER} + 1) % 18446744073709551616 AS n FROM walk WHERE jump <= 24)),
law AS (SELECT doc_id, max(jump) FILTER (WHERE jump < 24)::INT AS shard, max(jump) FILTER (WHERE jump <= 24)::INT AS grown_shard FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(strlen(text), 0) + 8 AS size, shard, grown_shard FROM documents d JOIN law l ON l.doc_id IS NOT DISTINCT FROM d.doc_id
"""
BASE_COUNTS = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: list_transform(list_reverse(string_split(regexp_replace(x, '[^0-9]', '', 'g'), '')), lambda d: d::INT)) AS cards,
    list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, len(emails) AS n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: p::HUGEINT > 255)) = 0)) AS n_ip,
  len(list_filter(cards, lambda c: len(c) BETWEEN 12 AND 19 AND list_sum(list_transform(c, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d < 5 THEN 2 * d ELSE 2 * d - 9 END)) % 10 = 0)) AS n_card,
  len(list_filter(phones, lambda n: n BETWEEN 9 AND 15)) AS n_phone
FROM t
"""
URL_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) AS rule)
SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) AS rule
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_reassembly": OP1, "op5_exact_dedup": OP5, "op8_ngram_jaccard": OP8, "op11_merkle_manifest": OP11, "op12_chat_format": OP12, "llm_shard_law": SHARD_LAW, "llm_base_counts": BASE_COUNTS, "llm_url_rules": URL_RULES}
