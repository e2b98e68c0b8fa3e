"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back, unescape
from .decontaminate import find_contamination_in_parts
from .fingerprints import fingerprint_with_edits
from .importance import resample
from .language_model import score_texts
from .line_dedup import drop_common_lines
from .mixing import mix_sources
from .ngram_join import link_near_copies
from .quality import fit_quality, held_out, score_quality
from .simhash import link_near_fingerprints
from .substrings import drop_repeats
from .url_filter import FALLBACK_RULES, HOST_RULES, judge_urls
from .whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = fit_quality(docs, _read(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha256(F.col("text")).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), HOST_RULES, FALLBACK_RULES)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_copies(_read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    formatted = format_conversations(conversations.unionByName(extra))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["text_begin"] : s["text_end"]]) for s in spans if s["learn"])
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": object})

    return formatted.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_with_edits(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", _sha256(F.col("edited_text")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination_in_parts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(_read(spark, sf_dir, "embeddings"))
    rows = out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_fingerprints(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_language_model": op6_language_model,
    "op7_ngram_join": op7_ngram_join,
    "op8_chat": op8_chat,
    "op9_fingerprints": op9_fingerprints,
    "op10_decontaminate": op10_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_importance": op13_importance,
}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, common.key IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|\.)(ads|adserver|tracker)\.') THEN 'block'
    WHEN regexp_matches(path, '/(ads|adserver|banner)/') THEN 'block'
    WHEN regexp_matches(path, '/(login|signup|cart|checkout)(/|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
""",
    "op3_substring_dedup": r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, words FROM texts
), windows AS (
  SELECT doc_id, p, words[p] AS word, CASE WHEN p + 19 <= len(words) THEN md5(array_to_string(words[p:p + 19], ' ')) END AS key FROM places
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS turn FROM windows WHERE key IS NOT NULL) WHERE turn > 1
), marked AS (
  SELECT w.doc_id, w.p, w.word, coalesce(max(l.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) >= w.p - 19, false) AS gone
  FROM windows w LEFT JOIN later l ON w.doc_id = l.doc_id AND w.p = l.p
)
SELECT t.doc_id, count(m.p) AS n_words, count(*) FILTER (WHERE m.gone) AS n_removed, sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM texts t LEFT JOIN marked m ON t.doc_id = m.doc_id GROUP BY t.doc_id
""",
    "op10_decontaminate": r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), asked AS (
  SELECT DISTINCT item, k, array_to_string(words[s:s + k - 1], ' ') AS key
  FROM (SELECT item, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s FROM items WHERE len(words) > 0)
), lengths AS (
  SELECT DISTINCT k FROM asked
), found AS (
  SELECT d.doc_id, d.s, d.k, a.item
  FROM (SELECT doc_id, s, k, array_to_string(words[s:s + k - 1], ' ') AS key FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM texts, lengths WHERE len(words) >= k)) d
  JOIN asked a ON d.k = a.k AND d.key = a.key
), ends AS (
  SELECT doc_id, s, max(s + k) AS e FROM found GROUP BY doc_id, s
), places AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p FROM texts
), hits AS (
  SELECT doc_id, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_hit FROM (
    SELECT p.doc_id, max(e.e) OVER (PARTITION BY p.doc_id ORDER BY p.p) > p.p AS hit FROM places p LEFT JOIN ends e ON p.doc_id = e.doc_id AND p.p = e.s
  ) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hits ON t.doc_id = hits.doc_id LEFT JOIN named ON t.doc_id = named.doc_id
""",
    "op13_importance": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), in_docs AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM docs) GROUP BY ALL
), counts AS (
  SELECT word, sum(s) AS s, sum(t) AS t FROM (
    SELECT word, n AS s, 0 AS t FROM in_docs UNION ALL SELECT word, 0, 1 FROM (SELECT unnest(words) AS word FROM items)
  ) GROUP BY word
), bytes AS (
  SELECT word, s, t, list_transform(range(1, strlen(word) + 1), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(word), 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(word), 2 * i, 1)) - 1) AS bytes
  FROM counts
), coded AS (
  SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, bytes), lambda crc, byte:
      list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 10000 AS bucket
  FROM bytes
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(sum(s) AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM coded, (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM counts) GROUP BY bucket, all_s, all_t
), weights AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM in_docs JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs d LEFT JOIN weights w ON d.doc_id = w.doc_id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
""",
    "op7_ngram_join": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[s:s + 4], ' ')) AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sizes a ON u = a.doc_id JOIN sizes b ON v = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, place) AS (
  SELECT u, v FROM ways UNION SELECT reach.doc_id, ways.v FROM reach JOIN ways ON reach.place = ways.u
), least_ AS (
  SELECT doc_id, min(place) AS place FROM reach GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(place, t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes ON t.doc_id = sizes.doc_id LEFT JOIN least_ ON t.doc_id = least_.doc_id
""",
}
