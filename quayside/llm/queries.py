"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import format_conversations
from .conversation_repair import damaged, repair_digests
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .locally_consistent import compare_with_edits
from .packing import pack
from .pii import replace_entities
from .quality import score_quality
from .secrets import find_secrets
from .sharding import shard_documents
from .shared import read_table
from .simhash import near_duplicates
from .toxicity import score_toxicity
from .whitening import whiten


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _word_tokenizer() -> str:
    """Where the public tokenizer's file is; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), _word_tokenizer(), capacity=2048)


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=24)


def op4_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"), owner="source", repository="doc_id")


def op5_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the oracle has; the operator's row ids and locators stay inside."""
    found = exact_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a real deployment passes its own secret key
    return replace_entities(read_table(spark, sf_dir, "documents"), key=b"quayside example key")


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, radius=3)


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts look like control strings."""
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    return format_conversations(conversations.unionByName(odd))


def op11_locally_consistent_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(read_table(spark, sf_dir, "conversations")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(read_table(spark, sf_dir, "embeddings"), components=32)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotrained_quality": op1_cotrained_quality,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_ownership_secrets": op4_ownership_secrets,
    "op5_streaming_exact_dedup": op5_streaming_exact_dedup,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_toxicity_neighbours": op7_toxicity_neighbours,
    "op8_simhash_pigeonhole": op8_simhash_pigeonhole,
    "op9_simhash_decontamination": op9_simhash_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_locally_consistent_fingerprints": op11_locally_consistent_fingerprints,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": pipeline,
}
#: The damage by a table of CRC-32 remainders; the repair turn by turn, the cheapest of each last role kept with its audit and text.
REPAIR_SQL = """
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
      given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
      turns AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM turns),
      judged AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM placed),
      steps AS (SELECT conv_id, 0 AS i, [{'q': '', 'c': 0, 'a': '', 't': ''}] AS best FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT s.conv_id, j.i, list_filter([CASE WHEN len(x) > 0 THEN {'q': x[1].q, 'c': x[1].c, 'a': x[1].a, 't': x[1].t} END
            FOR x IN [list_sort([{'c': y.c, 'a': y.a, 't': y.t, 'q': y.q} FOR y IN o IF y.q = q]) FOR q IN ['', 's', 'u', 'a']]], lambda y: y IS NOT NULL)
        FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1, LATERAL (SELECT flatten(list_transform(s.best, lambda b: list_concat(
          [{'q': b.q, 'c': b.c + 4, 'a': b.a || 'D', 't': b.t}],
          CASE WHEN j.fault IN ('b', 'd') THEN [] ELSE list_concat(
            CASE WHEN j.r = 's' AND b.q = '' THEN [{'q': 's', 'c': b.c + 3 * CAST(j.fault = 't' AS INTEGER), 'a': b.a || 'K', 't': b.t || chr(10) || j.role || ':' || j.text}] ELSE [] END,
            list_transform(['u', 'a'], lambda z: {'q': z,
              'c': b.c + 3 * CAST(j.fault = 't' AS INTEGER) + 3 * CAST(j.r <> z AS INTEGER) + 3 * CAST((z = 'u') = (b.q = 'u') AS INTEGER),
              'a': b.a || CASE WHEN (z = 'u') = (b.q = 'u') THEN 'I' ELSE '' END || CASE WHEN j.r = z THEN 'K' ELSE 'R' END,
              't': b.t || CASE WHEN (z = 'u') = (b.q = 'u') THEN chr(10) || CASE z WHEN 'a' THEN 'user:' ELSE 'assistant:' END ELSE '' END
                || chr(10) || CASE WHEN j.r = z THEN j.role WHEN z = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text})) END))) AS o)),
      ends AS (SELECT conv_id, list_sort(list_transform(best, lambda b: {'c': b.c + CASE b.q WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, 'a': b.a || CASE b.q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
          't': b.t || CASE b.q WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END}))[1] AS e
        FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
      counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
    SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(CASE WHEN e.t = '' THEN '' ELSE e.t[2:] END) AS repaired_sha256
    FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id"""

ORACLES: dict[str, str] = {
    "op12_conversation_repair": REPAIR_SQL,
    "op5_streaming_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
