"""The queries of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, exact, jaccard, lm, merkle, mixing, neardup, packing, quality, secrets, sharding, tokens
from tessera.llm.common import documents


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_file(documents(spark, sf_dir), tokens.tokenizer_path("word_bpe_49k.json"), end_id=1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(documents(spark, sf_dir)).drop("row")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id", "source"), F.col("doc_id")).select("doc_id", "source", "slot", "shard")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokens.tokenizer_path("word_bpe_49k.json"), end_id=0)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(documents(spark, sf_dir))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {
    "op1_token_file": op1_token_file,
    "op2_quality_rules": op2_quality_rules,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_mix_sources": op6_mix_sources,
    "op7_lm_score": op7_lm_score,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_shard": op9_shard,
    "op10_pack": op10_pack,
    "op11_merkle": op11_merkle,
    "op12_near_vectors": op12_near_vectors,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(w, lambda x: list_contains([{", ".join(repr(x) for x in dict.fromkeys(quality.STOP_WORDS.split()))}], lower(x)))) AS n_stop
    FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR coalesce(word_chars / n_words < 2.0 OR word_chars / n_words > 16.0 OR n_symbols / n_words > 0.5 OR n_stop / n_words < 0.04, false)
    OR coalesce(n_dup_lines / n_lines > 0.5, false)) AS kept FROM b"""

_EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""

_CHAT_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t),
p AS (SELECT conv_id, place, string_agg(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'), '') OVER (PARTITION BY conv_id ORDER BY place) AS said FROM n),
e AS (SELECT conv_id, max(place) AS n_turns, arg_max(said, place) AS said FROM p GROUP BY conv_id),
i AS (SELECT DISTINCT p.said FROM p JOIN e USING (conv_id) WHERE p.place < e.n_turns),
k AS (SELECT min(conv_id) AS conv_id FROM e WHERE said NOT IN (SELECT said FROM i) GROUP BY said)
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM n JOIN k USING (conv_id) GROUP BY conv_id"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _secrets_sql() -> str:
    parts = []
    for k, rule in enumerate(secrets.RULES):
        p = _quoted(rule.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'g': length(g[i])}})) AS x "
            f"FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS m, regexp_extract_all(coalesce(text, ''), '{p}', {rule.group}) AS g, regexp_split_to_array(coalesce(text, ''), '{p}') AS b FROM documents)"
        )
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(secrets.RULES))
    n = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    return f"""
WITH s AS (SELECT doc_id, k, x.s::BIGINT AS s, kind || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT AS said FROM ({" UNION ALL ".join(parts)}) WHERE x.g >= CASE k {least} END)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < {n}), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY s, k), '') AS spans
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


_MIX_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key, len({_WORDS})::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM z),
f AS (SELECT 0 AS step, NULL::BIGINT[] AS full_ UNION ALL
  SELECT step + 1, (SELECT list(rank ORDER BY rank) FROM w WHERE list_contains(coalesce(full_, []), rank) OR
    weight * (1.5 * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(2 * source_size) FROM w WHERE list_contains(coalesce(full_, []), rank)), 0))
    >= 2 * source_size * (SELECT sum(weight) FROM w WHERE NOT list_contains(coalesce(full_, []), rank)))
  FROM f WHERE step < 60),
l AS (SELECT coalesce(full_, []) AS full_ FROM f ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN list_contains(full_, rank) THEN (2 * source_size)::DOUBLE ELSE weight *
    (1.5 * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(2 * source_size) FROM w WHERE list_contains(full_, rank)), 0)) /
    (SELECT sum(weight) FROM w WHERE NOT list_contains(full_, rank)) END AS target FROM w, l),
r AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id) AS s FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT r.*, sum(size) OVER (ORDER BY (s + p * source_size) / target, key, size, doc_id, p ROWS UNBOUNDED PRECEDING) AS c FROM r, (VALUES (0), (1)) v(p) WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, source, sum(size)::BIGINT AS taken FROM q WHERE c <= (SELECT sum(target) FROM t) GROUP BY doc_id, source)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM r LEFT JOIN k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.source IS NOT DISTINCT FROM k.source"""

_PART = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC_BIT = "list_reduce([{0}] || range(0, 8), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = "list_reduce([4294967295] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])), lambda c, b: " + _CRC_BIT.format("xor(c, b)") + ")"

_MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF.format(text="text")} AS leaf, coalesce('1' || source, '0') AS tree,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS copied FROM documents),
r AS (SELECT doc_id, tree, leaf, coalesce(copied, leaf) AS copied, row_number() OVER () AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n AS (SELECT 0 AS level, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS c FROM r UNION ALL
    SELECT level + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (c + 2) // 3 FROM n WHERE c > 1 GROUP BY level, tree, pos // 3, c),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE c = 1),
t AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS c FROM s UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (c + 2) // 3 FROM t WHERE c > 1 GROUP BY level, pos // 3, c),
a AS (SELECT tree, level, pos, h, c FROM n UNION ALL SELECT '', level, pos, h, c FROM t),
b AS (SELECT tree, level, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM a WHERE c > 1 WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)),
p AS (SELECT rid, level AS step, lefts, rights FROM r JOIN b ON b.tree = r.tree AND b.pos = r.pos // pow(3, level)::BIGINT UNION ALL
    SELECT rid, 1000 + level, lefts, rights FROM r JOIN s USING (tree) JOIN b ON b.tree = '' AND b.pos = s.pos // pow(3, level)::BIGINT),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) AS k FROM p),
f AS (SELECT rid, 0 AS k, copied AS node FROM r UNION ALL SELECT f.rid, f.k + 1, sha256(lefts || node || rights) FROM f JOIN k ON k.rid = f.rid AND k.k = f.k + 1),
e AS (SELECT rid, arg_max(node, k) AS folded_root FROM f GROUP BY rid),
q AS (SELECT rid, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof FROM k GROUP BY rid),
z AS (SELECT h AS root FROM t WHERE c = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN s USING (tree) JOIN e USING (rid) LEFT JOIN q USING (rid), z"""

#: All pairs: what the index finds where it misses nothing, as on tables of one cell.
_NEAR_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER () AS rid, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, CASE WHEN len(a.v) = len(b.v) THEN b.v ELSE a.v END) >= 0.9),
r AS (SELECT rid AS a, rid AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a, min(e.vec_id) AS component_id FROM r JOIN e ON e.rid = r.b GROUP BY r.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c ON c.a = e.rid LEFT JOIN n ON n.a = e.rid"""

SQL = {
    "op2_quality_rules": _QUALITY_SQL,
    "op3_exact_dedup": _EXACT_SQL,
    "op4_chat_format": _CHAT_SQL,
    "op5_secret_scan": _secrets_sql(),
    "op6_mix_sources": _MIX_SQL,
    "op11_merkle": _MERKLE_SQL,
    "op12_near_vectors": _NEAR_SQL,
}
