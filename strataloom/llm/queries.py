"""The pN_ queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.tokens import token_count
from strataloom.llm import conversations, encoding, items, mixing, neardup, pii, quality, splitting, vectors
from strataloom.operators.current import file_row
from strataloom.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = vectors.SearchConfig(min_similarity=0.9, recall=0.995, either=True)
    near = vectors.neighbours(vectors.current_vectors(table(spark, sf_dir, "chunk_records"), file_row()), config=config)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar records of every twentieth record (by a hash of its id), against all records."""
    twentieth = F.pmod(F.xxhash64("id"), F.lit(20)) == 0
    return vectors.neighbours(vectors.current_vectors(table(spark, sf_dir, "chunk_records"), file_row()), twentieth)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all current documents and chunks above the limit."""
    limit = splitting.SplitConfig().max_tokens
    current = items.current_items(items.delivered_items(spark, sf_dir), ["text", "section_path"], token_count(F.col("text")) > limit)
    return splitting.split_oversized(current)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_index = 0").select("item_kind", "item_id")


def _kept_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "chat_turns"), table(spark, sf_dir, "chat_conversations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_turns(spark, sf_dir).select("conversation_id", "turn_pos", "node_id")


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept turns with speaker, text and marks of new sessions."""
    return conversations.with_sessions(_kept_turns(spark, sf_dir), table(spark, sf_dir, "chat_turns"))


P4 = neardup.NearDupConfig(words=3, similarity=0.7, min_words=20)  # as TESTDATA.md states them


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(items.delivered_items(spark, sf_dir).drop("row_id"), P4)
    return neardup.pairs_of_ids(members, links, P4)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its class, and the number of other classes that are near it."""
    members, links = neardup.near_duplicates(items.delivered_items(spark, sf_dir).drop("row_id"), P4)
    ends = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    return members.join(ends, "cid", "left").na.fill(0, ["links"])


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pii.PiiConfig()
    lexicon = pii.lexicon_of(table(spark, sf_dir, "name_lexicon"), config)
    current = items.current_items(items.delivered_items(spark, sf_dir), ["text"])
    crf = pii.fit(pii.label_table(items.delivered_items(spark, sf_dir), lexicon, config), lexicon, config)
    return pii.find(current, crf, lexicon, config)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _mentions(spark, sf_dir).select("item_kind", "item_id", F.explode("mentions").alias("m"))
    return each.select("item_kind", "item_id", "m.entity", "m.span_start")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current text with its mentions replaced by placeholders."""
    return pii.redacted(_mentions(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = encoding.count_tokens(table(spark, sf_dir, "documents"), carry="source")
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, distance and kind of every document."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_turns": p3_turns, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found, "p8_quality": p8_quality}


def _conversations_sql() -> str:
    """p3_found along TESTDATA's sentence: a recursive walk for linked conversations, an order for flat ones."""
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    said = "trim(regexp_replace(lower(role), '^[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+|[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+$', '', 'g'))"
    speaker = " ".join(f"WHEN {said} IN ({quoted(spellings)}) THEN '{who}'" for who, spellings in conversations.SPEAKERS.items())
    return f"""
        WITH RECURSIVE r AS (
          SELECT conversation_id, node_id, nullif(parent, '') AS parent, CASE WHEN isnan(create_time) THEN NULL WHEN abs(create_time) >= 1e11 THEN create_time / 1000 ELSE create_time END AS tm,
            try_cast(nullif(regexp_extract(node_id, '^flat-([0-9]{{1,18}})$', 1), '') AS BIGINT) AS number,
            CASE WHEN text IS NULL OR regexp_full_match(text, '[\\s\\v\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]*') OR coalesce(recipient, '') NOT IN ('', 'all') OR coalesce(content_type, '') IN ({quoted(conversations.HIDDEN_CONTENT)})
              OR coalesce(lower(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.is_visually_hidden_from_conversation') END) = 'true', false) THEN NULL {speaker} END AS speaker
          FROM chat_turns WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id, node_id ORDER BY arrived_at DESC) = 1),
        heads AS (SELECT conversation_id, current_node FROM chat_conversations WHERE conversation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY arrived_at DESC) = 1),
        kind AS (SELECT conversation_id, current_node, count(*) AS n, count(parent) > 0 AS linked, count(number) = count(*) AS numbered FROM r JOIN heads USING (conversation_id) GROUP BY ALL),
        leaf AS (SELECT conversation_id, arg_max(node_id, (tm IS NOT NULL, coalesce(tm, 0.0), node_id)) AS node_id FROM r
          WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.conversation_id = r.conversation_id AND c.parent = r.node_id) GROUP BY 1),
        start AS (SELECT k.conversation_id, coalesce(h.node_id, l.node_id) AS node_id, k.n FROM kind k LEFT JOIN r h ON h.conversation_id = k.conversation_id AND h.node_id = k.current_node
          LEFT JOIN leaf l ON l.conversation_id = k.conversation_id WHERE k.linked),
        walk AS (SELECT r.conversation_id, r.node_id, r.parent, r.speaker, 0 AS depth, n FROM r JOIN start USING (conversation_id, node_id)
          UNION ALL SELECT r.conversation_id, r.node_id, r.parent, r.speaker, depth + 1, n FROM walk w JOIN r ON r.conversation_id = w.conversation_id AND r.node_id = w.parent WHERE depth < n),
        path AS (SELECT conversation_id, node_id, speaker, -depth AS place FROM walk WHERE conversation_id IN (SELECT conversation_id FROM walk WHERE parent IS NULL)
          UNION ALL SELECT conversation_id, node_id, speaker, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN numbered THEN number END, CASE WHEN NOT numbered THEN tm END NULLS FIRST, node_id) FROM r JOIN kind USING (conversation_id) WHERE NOT linked),
        turns AS (SELECT conversation_id, row_number() OVER w - 1 AS turn_pos, node_id, speaker, lead(speaker) OVER w AS reply FROM path WHERE speaker IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY place))
        SELECT conversation_id, turn_pos, node_id FROM turns
        QUALIFY bool_and((speaker = 'assistant' OR coalesce(reply, '') = 'assistant') AND (turn_pos > 0 OR speaker = 'user')) OVER (PARTITION BY conversation_id)"""


def oracle_sql() -> dict[str, str]:
    from strataloom.plans.corpus_plans import TOKEN_SQL, current_sql

    def count(column: str) -> str:
        return f"len(regexp_extract_all(coalesce({column}, ''), '{TOKEN_SQL}'))"

    return {
        "p3_found": _conversations_sql(),
        "p2_found": f"""
            SELECT 'document' AS item_kind, document_id AS item_id FROM {current_sql('norm_documents', 'document_id')} WHERE {count('content')} > 512
            UNION ALL SELECT 'chunk', chunk_id FROM {current_sql('knowledge_chunks', 'chunk_id')} WHERE {count('text')} > 512""",
    }
