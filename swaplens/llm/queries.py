"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    conversation_trie,
    decontamination,
    exact_topk,
    fingerprints,
    mixing,
    near_dedup,
    quality,
    substring_dedup,
    token_counts,
    token_output,
    url_filter,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_table(spark, sf_dir, "documents"), tokenizer=token_output.default_tokenizer())


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer=token_output.default_tokenizer())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, url_filter.RULES)
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


#: Conversation -1: both turns hold control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(more)))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = conversation_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))
    return trie.withColumn("n_nodes", F.col("subtree_end") - F.col("preorder")).drop("preorder", "subtree_end")  # places follow hashes


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package and imports it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in url_filter.RULES)

#: By comparing every url with every rule.
_URL_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
rest AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT k, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, p.host, p.path, u.host || u.path AS rule, coalesce(u.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(u.host || u.path) DESC, length(u.host) DESC, u.verdict DESC) = 1
"""

_CHAT_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
escaped AS (SELECT *, replace(replace(t, '\\', '\\\\'), '<|', '<\\|') AS e, replace(replace(replace(r, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n') AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(CAST(sum(length(t)) FILTER (r = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || n || chr(10) || e || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


#: CRC-32 of the decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""

#: By prefixes spelled out; a node's subtree is what has it among its prefixes.
_TRIE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(d) AS own, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM t GROUP BY conv_id),
a AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
f AS (SELECT a.conv_id, t.d, r, x FROM a JOIN t ON t.conv_id = a.base AND t.d <= a.h
  UNION ALL SELECT a.conv_id, t.d - a.h + a.k, r, x FROM a JOIN t ON t.conv_id = a.conv_id AND t.d > a.h),
paths AS (SELECT conv_id, d, strlen(x) AS bytes, array_to_string(list(md5(md5(r) || md5(x))) OVER (PARTITION BY conv_id ORDER BY d), ',') AS path FROM f
  UNION ALL SELECT conv_id, 0, 0, '' FROM a),
m AS (SELECT p.conv_id, p.d, p.bytes, path, lag(path) OVER (PARTITION BY p.conv_id ORDER BY p.d) AS above, p.d = a.k + greatest(a.own - a.h, 0) AS ends FROM paths p JOIN a USING (conv_id)),
v AS (SELECT d, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, path),
s AS (SELECT m.d, m.path, count(*) FILTER (leaf) AS leaves, sum((v.n - 1) * v.bytes) AS saved FROM v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.d, m.path),
kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n FROM v WHERE d > 0 GROUP BY d, above),
sizes AS (SELECT m.d, m.path, count(*) AS nodes FROM v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.d, m.path)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256, sizes.nodes AS n_nodes
FROM v JOIN s USING (d, path) JOIN sizes USING (d, path) LEFT JOIN kids USING (d, path) LEFT JOIN v u ON u.d = v.d - 1 AND u.path = v.above
"""


def _assigned_sql(entries: str) -> str:
    return f"SELECT k, p, min(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + j) AS best FROM parts JOIN {entries} USING (p) GROUP BY k, p"


def _learned_sql(entries: str, assigned: str) -> str:
    return f"""SELECT e.p, e.j, coalesce(y2, y) AS y FROM {entries} e LEFT JOIN (SELECT p, j, list((s - (s % n + n) % n) // n ORDER BY i) AS y2 FROM
  (SELECT p, best % 64 AS j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM parts JOIN {assigned} USING (k, p), range(1, len(x) + 1) r(i) GROUP BY ALL) GROUP BY p, j) USING (p, j)"""


#: Every distance, to every entry.
_CODES_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT k, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
e0 AS MATERIALIZED (SELECT p, j, x AS y FROM parts JOIN (SELECT k, row_number() OVER (ORDER BY vec_id, v) - 1 AS j FROM kept) USING (k) WHERE j < 64),
a0 AS MATERIALIZED ({_assigned_sql('e0')}), e1 AS MATERIALIZED ({_learned_sql('e0', 'a0')}), a1 AS MATERIALIZED ({_assigned_sql('e1')}), e2 AS MATERIALIZED ({_learned_sql('e1', 'a1')}),
a2 AS ({_assigned_sql('e2')}),
done AS (SELECT k, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY k),
books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN done USING (k), books
"""

#: Every score.
_TOPK_SQL = """
WITH kept AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) <= 20
"""


def oracle_sql() -> dict[str, str]:
    """The others have learned models, tokenizers, random draws or fingerprints that SQL lacks; tests
    hold them against brute force."""
    return {
        "op7_url_filter": _URL_SQL, "op9_chat_format": _CHAT_SQL, "op11_conversation_trie": _TRIE_SQL, "op12_vector_codes": _CODES_SQL,
        "op13_exact_topk": _TOPK_SQL,
    }
