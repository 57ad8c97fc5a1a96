"""The registered queries of the operators: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import attention_lm, conversation_repair, jaccard_join, language_id, line_templates, mixing, packing, phrases, prefix_tokens, quality_rules, substring_dedup, suffix_dedup, vector_search
from marketlens.llm.tables import documents


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_removed (lines with a word) and the remaining text."""
    return line_templates.drop_lines(documents(spark, sf_dir)).selectExpr("doc_id", "_n_lines AS n_lines", "_n_removed AS n_removed", "text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_search.search(rows, rows.where("vec_id % 50 = 0"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(documents(spark, sf_dir))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.count_tokens(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_array_dedup, op2_source_mix, op3_quality_rules, op4_substring_dedup, op5_line_dedup, op6_best_fit_packing, op7_language_id, op8_vector_search, op9_jaccard_join, op10_attention_lm, op11_phrase_mining, op12_token_counts, op13_conversation_repair)
    return {f.__name__: f for f in found}


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, words, text FROM w),
g AS (SELECT doc_id, u.i AS i, u.g AS g FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {'i': i, 'g': words[i] || ' ' || words[i+1] || ' ' || words[i+2]})) AS u FROM w WHERE len(words) >= 3)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 15 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(failed AS BIGINT) AS failed FROM f
"""


_OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 30),
x AS (SELECT c.lang, c.phrase, c.a, cut, l.n AS l, r.n AS r, (2000000::HUGEINT * c.a) // (l.n::HUGEINT + r.n) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
s AS (SELECT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
h AS (SELECT lang, phrase, max(longer) AS longer FROM s GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * b.a)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score
FROM q JOIN t ON t.lang = q.lang QUALIFY rank <= 2000
"""

_OP13_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS bytes FROM conversations),
z AS (SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], bytes), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS bare,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM o),
f AS (SELECT *, bare OR again AS gone, cut AND NOT bare AND NOT again AS short FROM e),
-- labels by state (0 start, 1 after system, 2 after user, 3 after assistant): cost, audit, repaired rows
v AS (SELECT conv_id, 0::BIGINT AS i,
    {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS l0, {'c': 1000000::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS l1,
    {'c': 3::BIGINT, 'a': 'I', 'o': ['user:']} AS l2, {'c': 6::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']} AS l3
    FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, l0, l1, l2, list_sort([l3, {'c': l2.c + 3, 'a': l2.a || 'I', 'o': list_append(l2.o, 'assistant:')}])[1] AS l3 FROM (
    SELECT conv_id, i, l0, l1, l3, list_sort([l2, {'c': l0.c + 3, 'a': l0.a || 'I', 'o': list_append(l0.o, 'user:')}, {'c': l1.c + 3, 'a': l1.a || 'I', 'o': list_append(l1.o, 'user:')},
        {'c': l3.c + 3, 'a': l3.a || 'I', 'o': list_append(l3.o, 'user:')}])[1] AS l2 FROM (
      SELECT v.conv_id, f.i,
        {'c': l0.c + 4, 'a': l0.a || 'D', 'o': l0.o} AS l0,
        list_sort([{'c': l1.c + 4, 'a': l1.a || 'D', 'o': l1.o}, {'c': CASE WHEN gone OR f.c <> 's' THEN 1000000 ELSE l0.c + 3 * CAST(short AS INT) END, 'a': l0.a || 'K', 'o': list_append(l0.o, f.role || ':' || f.text)}])[1] AS l1,
        list_sort(list_concat([{'c': l2.c + 4, 'a': l2.a || 'D', 'o': l2.o}], list_transform([l0, l1, l3], lambda x: {'c': CASE WHEN gone THEN 1000000 ELSE x.c + 3 * CAST(short AS INT) + CASE WHEN f.c = 'u' THEN 0 ELSE 3 END END,
            'a': x.a || CASE WHEN f.c = 'u' THEN 'K' ELSE 'R' END, 'o': list_append(x.o, CASE WHEN f.c = 'u' THEN f.role ELSE 'user' END || ':' || f.text)})))[1] AS l2,
        list_sort([{'c': l3.c + 4, 'a': l3.a || 'D', 'o': l3.o}, {'c': CASE WHEN gone THEN 1000000 ELSE l2.c + 3 * CAST(short AS INT) + CASE WHEN f.c = 'a' THEN 0 ELSE 3 END END,
            'a': l2.a || CASE WHEN f.c = 'a' THEN 'K' ELSE 'R' END, 'o': list_append(l2.o, CASE WHEN f.c = 'a' THEN f.role ELSE 'assistant' END || ':' || f.text)}])[1] AS l3
      FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1))),
b AS (SELECT conv_id, list_sort([l0, l3])[1] AS l FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(bare) AS blank, count_if(again AND NOT bare) AS duplicate, count_if(short) AS truncated,
    count_if(i > 1 AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, l.c AS cost, l.a AS audit, sha256(array_to_string(l.o, chr(10))) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _OP3_SQL, "op11_phrase_mining": _OP11_SQL, "op13_conversation_repair": _OP13_SQL}
