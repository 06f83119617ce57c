"""The ten operators as registered queries, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.llm import bpe, chat, decontaminate, lang_id, line_dedup, media_chunks, near_dedup, pii, secret_scan, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.documents_rollup(spark, _table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(vocabulary_path()))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_columns(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


def held_out() -> Column:
    """Documents that language models must not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame) -> lang_id.Model:
    return lang_id.train(docs.filter(~held_out()), lang_id.pieces_of(vocabulary_path("piece_bpe_32k.model")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out, lang_pred, score, _ = lang_id.identified(docs.select("doc_id", "text"), language_model(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col(lang_pred).alias("lang_pred"), F.col(score).alias("score"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_media_chunks": op7_media_chunks,
    "op8_chat": op8_chat,
    "op9_secrets": op9_secrets,
    "op10_language_id": op10_language_id,
}

_OP1 = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t FROM documents
), c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n, length(regexp_extract(t, '(?s)[^\x20\x09-\x0D](.*[^\x20\x09-\x0D])?')) AS chars
  FROM d WHERE regexp_matches(t, '[^\x20\x09-\x0D]')
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]')), length(regexp_extract(t, '(?s)[^\x20\x09-\x0D](.*[^\x20\x09-\x0D])?'))
  FROM d WHERE regexp_matches(t, '[^\x20\x09-\x0D]')
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens, sum(chars)::BIGINT AS n_chars
FROM c GROUP BY source, lang, tokenizer
"""

_OP2 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw
), iw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), iset AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw
), n AS (
  SELECT item_id, count(*)::BIGINT AS n_item FROM iset GROUP BY item_id
), m AS (
  SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM ds JOIN iset USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item::DOUBLE, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""

# the templates are written out as text here
_OP6 = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(ls)))::INT AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), t AS (
  SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ts FROM l
), u AS (
  SELECT doc_id, pos, len(ts) AS n, list_transform(ts, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM t
  WHERE len(ts) >= 3 OR (len(ts) > 0 AND strlen(array_to_string(ts, ' ')) >= 90)
), fields AS (
  SELECT *, unnest([{'f': 0, 'a': n, 'b': n}]) AS x FROM u
  UNION ALL
  SELECT *, unnest(list_transform(range(2, n), lambda i: {'f': i - 1, 'a': i, 'b': i + 1})) FROM u WHERE n BETWEEN 5 AND 8
  UNION ALL
  SELECT *, unnest([{'f': 1, 'a': 2, 'b': 2 + (n - 2) // 3}, {'f': 2, 'a': 2 + (n - 2) // 3, 'b': 2 + 2 * ((n - 2) // 3)}, {'f': 3, 'a': 2 + 2 * ((n - 2) // 3), 'b': n}]) FROM u WHERE n >= 9
), filled AS (
  SELECT doc_id, pos, n, x.f AS f, w[1:x.a] || w[x.b + 1:] AS k FROM fields
), keys AS (
  SELECT doc_id, pos, n || ' ' || f || ' ' || array_to_string(k, ' ') AS key, CASE WHEN f = 0 AND n >= 50 THEN 2 ELSE 3 END AS least
  FROM filled WHERE 2 * len(list_filter(k, lambda x: x <> '<*>')) >= n
), hot AS (
  SELECT key, min(doc_id) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= min(least)
), gone AS (
  SELECT DISTINCT doc_id, pos FROM keys JOIN hot USING (key) WHERE NOT (doc_id = first_doc AND pos = first_pos)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS body FROM l LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL GROUP BY l.doc_id
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n_dropped FROM gone GROUP BY doc_id
)
SELECT d.doc_id,
  CASE WHEN n.n_dropped IS NULL THEN coalesce(d.text, '') WHEN regexp_matches(coalesce(k.body, ''), '[^\x20\x09-\x0D]') THEN k.body ELSE '' END AS text,
  (CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END)::BIGINT AS n_lines,
  coalesce(n.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

# the template's marks by role; the automaton's legal beginnings are s?(ua)*u?, complete ones s?(ua)+
_OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, CASE role WHEN 'system' THEN length(e'<<SYS>>\n\n<</SYS>>\n') WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('  </s>') ELSE length('<s>[TURN]  [/TURN]') END
    + length(replace(text, '\', '\\')) + len(regexp_extract_all(replace(text, '\', '\\'), '[<\[](?:<SYS>>|</SYS>>|s>|/s>|INST\]|/INST\]|TURN\]|/TURN\])')) AS chars,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter FROM t
), c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars, string_agg(letter, '' ORDER BY turn, role, text) AS letters FROM u GROUP BY conv_id
)
SELECT * EXCLUDE (letters), regexp_full_match(letters, 's?(ua)+') AS valid,
  CASE WHEN length(regexp_extract(letters, '^s?(?:ua)*u?')) < length(letters) THEN length(regexp_extract(letters, '^s?(?:ua)*u?')) END::BIGINT AS broken_at FROM c
"""


def _spans_sql(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: texts between matches and the matches give running offsets."""
    p = "'" + pattern.replace("'", "''") + "'"
    sums = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
    each = f"list_transform(range(1, len(found) + 1), lambda i: {{'lo': {sums}, 'n': length(found[i]), 'v': vals[i]}})"
    return f"SELECT doc_id, owner, {no} AS no, '{kind}' AS kind, x.lo AS lo, x.lo + x.n AS hi, x.v AS v FROM (SELECT doc_id, owner, unnest({each}) AS x FROM (SELECT doc_id, owner, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps FROM d)) WHERE length(x.v) >= {least}"


# private keys are left out: their pattern is not one of this engine's, and the tables hold none
_OP9 = f"""
WITH d AS (
  SELECT doc_id, split_part(coalesce(source, ''), '/', 1) AS owner, coalesce(text, '') AS t FROM documents
), spans AS (
  {' UNION ALL '.join(_spans_sql(i, *k) for i, k in enumerate([*secret_scan.BASE, *secret_scan.ADDED]) if k[0] != 'pem')}
), owners AS (
  SELECT v, count(DISTINCT owner) >= {secret_scan.SHARED_OWNERS} AS example FROM spans GROUP BY v
), s AS (
  SELECT doc_id, no, kind || ':' || lo || ':' || hi AS digest, lo, example FROM spans JOIN owners USING (v) WHERE no < {len(secret_scan.BASE)} OR NOT example
), a AS (
  SELECT doc_id, count_if(no = 0) AS n_assign, count_if(no = 1) AS n_access, count_if(no = 2) AS n_hex, string_agg(digest, ',' ORDER BY lo, no) FILTER (no < {len(secret_scan.BASE)}) AS base, string_agg(digest, ',' ORDER BY lo, no) AS spans,
    count_if(example) AS n_example, count_if(NOT example) AS n_live FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_example, 0)::BIGINT AS n_example, coalesce(n_live, 0)::BIGINT AS n_live FROM d LEFT JOIN a USING (doc_id)
"""

ORACLES = {"op1_token_counts": _OP1, "op2_decontamination": _OP2, "op5_near_dedup": _OP5, "op6_line_dedup": _OP6, "op8_chat": _OP8, "op9_secrets": _OP9}
