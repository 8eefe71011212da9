"""The registered queries of this package: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.llm import (
    bagminhash, chat, exact_dedup, gumbel_pieces, iblt, language, packing, phrases, pii, repair, token_files, toxicity, url_filter,
)
from kinsight.llm.common import run_folder, table
from kinsight.llm.encoding import vocabulary_path


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.digests(chat.format_conversations(given.unionByName(extra)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rules of the query: verdict, and host with the beginning of a path.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary_path("word_bpe_49k.json"), end_id=2)
    documents = token_files.read(spark, folder)
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.document_fingerprints(table(spark, sf_dir, "documents"), iblt.passages)


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gumbel_pieces.sample_segmentations(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after their rows are damaged."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damaged(given), given)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_bagminhash": op9_bagminhash,
    "op10_gumbel_pieces": op10_gumbel_pieces,
    "op11_pii": op11_pii,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

#: In ``formatted``, a control string inside a text is one character longer.
_CONTROL = r"<\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|\/s>)|\[\\*(?:INST\]|\/INST\])"

ORACLES: dict[str, str] = {
    "op1_chat_format": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, 33 + length(role) + len(regexp_extract_all(role, '{_CONTROL}'))
              + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars,
         len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}+|[^ \t\n\r\f\x0B\p{{L}}\p{{N}}]+')) + 4 AS tokens
  FROM c
), s AS (
  SELECT *, coalesce(sum(tokens) OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM p
), cells AS (
  SELECT *, start // 384 AS cell, tokens > 384 AS big FROM s
), system AS (
  SELECT conv_id, arg_min(tokens, start) AS sys_tokens, arg_min(chars, start) AS sys_chars, min(start) AS sys_start
  FROM cells WHERE role = 'system' GROUP BY conv_id
), windows AS (
  SELECT conv_id, cell, big, min(start) AS first, sum(tokens) AS span, sum(chars) AS chars FROM cells GROUP BY ALL
), roomy AS (
  SELECT w.*, sys_start, sys_start < first AS headed,
         least(256, 1024 - span - if(coalesce(sys_start < first, false), sys_tokens, 0)) AS room,
         if(coalesce(sys_start < first, false), sys_chars, 0) AS head_chars
  FROM windows w LEFT JOIN system s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
), history AS (
  SELECT w.conv_id, w.cell, w.big, sum(h.chars) AS chars
  FROM roomy w JOIN cells h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.start < w.first AND h.start >= w.first - w.room
    AND NOT (coalesce(w.headed, false) AND h.start = w.sys_start)
  GROUP BY ALL
), shown AS (
  SELECT w.conv_id, sum(w.chars + head_chars + coalesce(h.chars, 0)) AS formatted_chars
  FROM roomy w LEFT JOIN history h
    ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.cell = w.cell AND h.big = w.big
  GROUP BY w.conv_id
), said AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY start) AS turns,
         coalesce(string_agg(text, '' ORDER BY start) FILTER (role = 'assistant'), '') AS loss
  FROM s GROUP BY conv_id
)
SELECT said.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM said JOIN shown ON said.conv_id IS NOT DISTINCT FROM shown.conv_id
""",
    "op6_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE table_ AS (
  SELECT list(list_reduce(range(8), lambda c, b: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), i) ORDER BY i) AS t FROM range(256) r(i)
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fate
  FROM source, table_
), rows_ AS (
  SELECT conv_id, turn, if(fate = 4, 'user', role) AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(if(fate = 3, 2, 1))) AS nth
  FROM hashed WHERE fate <> 0
), marked AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         count(*) OVER (PARTITION BY conv_id) AS rows_
  FROM rows_
), faulty AS (
  SELECT *, CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM marked
), start_ AS (
  SELECT conv_id, rows_ + 1 AS i, {'c': 0, 's': ''} AS n, {'c': 6, 's': 'II'} AS s, {'c': 3, 's': 'I'} AS u, {'c': 0, 's': ''} AS a
  FROM faulty WHERE i = rows_
), back AS (
  SELECT * FROM start_
  UNION ALL
  SELECT conv_id, i, list_min([bn, {'c': u.c + 3, 's': 'I' || u.s}]), list_min([bs, {'c': u.c + 3, 's': 'I' || u.s}]), u, a
  FROM (
    SELECT conv_id, i, bn, bs, list_min([bu, {'c': ba.c + 3, 's': 'I' || ba.s}]) AS u, list_min([ba, {'c': bu.c + 3, 's': 'I' || bu.s}]) AS a
    FROM (
      SELECT f.conv_id, f.i,
        list_min([{'c': b.n.c + 4, 's': 'D' || b.n.s}, if(stays, {'c': b.u.c + 3 + e, 's': 'R' || b.u.s}, NULL),
                  if(stays AND initial = 's', {'c': b.s.c + e, 's': 'K' || b.s.s}, NULL),
                  if(stays AND initial = 'u', {'c': b.u.c + e, 's': 'K' || b.u.s}, NULL)]) AS bn,
        list_min([{'c': b.s.c + 4, 's': 'D' || b.s.s}, if(stays, {'c': b.u.c + 3 + e, 's': 'R' || b.u.s}, NULL),
                  if(stays AND initial = 'u', {'c': b.u.c + e, 's': 'K' || b.u.s}, NULL)]) AS bs,
        list_min([{'c': b.u.c + 4, 's': 'D' || b.u.s}, if(stays, {'c': b.a.c + 3 + e, 's': 'R' || b.a.s}, NULL),
                  if(stays AND initial = 'a', {'c': b.a.c + e, 's': 'K' || b.a.s}, NULL)]) AS bu,
        list_min([{'c': b.a.c + 4, 's': 'D' || b.a.s}, if(stays, {'c': b.u.c + 3 + e, 's': 'R' || b.u.s}, NULL),
                  if(stays AND initial = 'u', {'c': b.u.c + e, 's': 'K' || b.u.s}, NULL)]) AS ba
      FROM back b JOIN (SELECT *, fault NOT IN ('b', 'd') AS stays, if(fault = 't', 3, 0) AS e FROM faulty) f
        ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1
    )
  )
), best AS (
  SELECT conv_id, n.c AS cost, n.s AS audit FROM back WHERE i = 1
), walk AS (
  SELECT conv_id, 0 AS p, 0 AS i, 'n' AS state, '' AS whole, 0 AS kept FROM best
  UNION ALL
  SELECT conv_id, p + 1, if(edit = 'I', i, i + 1),
         CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN initial WHEN state = 'u' THEN 'a' ELSE 'u' END,
         CASE WHEN edit = 'D' THEN whole ELSE whole || if(kept > 0, chr(10), '')
           || CASE WHEN edit = 'K' THEN role WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || if(edit = 'I', '', text) END,
         kept + if(edit = 'D', 0, 1)
  FROM (
    SELECT w.*, audit[p + 1] AS edit, f.initial, f.role, f.text
    FROM walk w JOIN best ON best.conv_id IS NOT DISTINCT FROM w.conv_id AND p < length(audit)
    LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  )
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.p = length(b.audit)
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), sized AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM places
), phrases AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k AS size, count(*) AS a FROM sized GROUP BY ALL
  HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM phrases WHERE size > 1
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, l.a AS l, r.a AS r, n, c.k,
         1000 * CAST(c.a AS HUGEINT) * n // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, k + 1, c.size), ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, size, a, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS k FROM phrases WHERE size > 2
), inside AS (
  SELECT lang, w, a, size, k, unnest(range(1, size - k + 2)) AS i FROM inner_parts
), longer AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(a) AS longer FROM inside GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM weakest LEFT JOIN longer USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
""",
}
