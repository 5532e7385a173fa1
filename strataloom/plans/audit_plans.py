"""Audit queries. The events stand in for session logs: a user is a session, the time is the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import audit
from strataloom.operators.ranking import positions
from strataloom.plans.corpus_plans import current_sql
from strataloom.plans.tables import current, table
from strataloom.scratch import materialize


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    # A stable order within a session: time, then id.
    return e.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("line"), F.col("event_type").alias("type"), "event_id", "value")


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    last = audit.last_turn(_log(spark, d), "session", "line", start="click")
    return last.groupBy("session").agg(F.count("*").alias("rows_left"), F.max_by("event_id", "line").alias("last_event"))


def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    runs = _log(spark, d).groupBy("session").agg(F.max(F.col("type") == "purchase").alias("done"), F.max(F.col("type") == "click").alias("used"), F.max(F.col("value") > 50).alias("good"))
    return audit.run_metrics(runs, F.col("done"), F.col("used"), F.coalesce(F.col("good"), F.lit(False)))


def first_results(spark: SparkSession, d: str) -> DataFrame:
    calls = _log(spark, d).where("type = 'view' or type = 'click'").withColumn("call", F.concat_ws(":", F.col("session").cast("string"), "type"))
    return audit.first_per_call(calls.select("call", "line", "event_id"), "call", "line").select("call", "event_id", "duplicates")


def unresolved(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    calls = log.where("type = 'click'").select("session").distinct()
    return audit.unresolved_calls(calls, log.where("type = 'purchase'"), "session")


def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of current chunks: each document's answer cites its chunks in full, shortened, or wrongly, by chunk_index."""
    chunks = current(spark, d, "knowledge_chunks", ["chunk_id"], ["document_id", "chunk_index"]).where("document_id is not null")
    suffix = F.substring_index("chunk_id", ":", -1)
    said = F.when(F.col("chunk_index") % 4 == 0, F.concat(F.lit("see chunk_id: "), "chunk_id")).when(F.col("chunk_index") % 4 == 1, F.concat(F.lit("as in ...:chunk:"), suffix)).when(F.col("chunk_index") % 4 == 2, F.concat(F.lit("by `"), suffix, F.lit("`"))).otherwise("without a source")
    first = chunks.where("chunk_index < 3").select(F.col("document_id").alias("session_id"), F.struct("chunk_index", "chunk_id", said.alias("s")).alias("x"))
    answers = first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.s), ", ").alias("answer"))
    report = audit.citations(answers, chunks.select(F.col("document_id").alias("session_id"), "chunk_id"))
    return report.select("session_id", "status", "citation_format", "full_id_compliant", F.size("valid").alias("valid"), F.size("invalid").alias("invalid"), F.size("ambiguous").alias("ambiguous"), "retrieved_chunks")


#: Chunks of a document that one answer cites.
RUN = 64


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks by session, answers, evidence): answers that name every current chunk, one for each run of a document's chunks."""
    chunks = current(spark, d, "knowledge_chunks", ["chunk_id"], ["document_id", "chunk_index"]).where("document_id is not null")
    placed = positions(chunks, "document_id", ["chunk_index", "chunk_id"])
    run = F.floor(F.col("pos") / RUN)
    placed = placed.select(
        F.concat("document_id", F.lit("#"), run.cast("string")).alias("session_id"), "document_id", "chunk_id", "pos", F.pmod(F.col("pos") + F.ascii(F.right("document_id", F.lit(1))), F.lit(8)).alias("k"),
        F.pmod(run + F.ascii(F.right("document_id", F.lit(1))), F.lit(5)).alias("mode"), F.substring_index("chunk_id", ":", -1).alias("suffix"),
    )
    k = F.col("k")
    said = (
        F.when(k == 0, F.concat(F.lit("see chunk_id: "), "chunk_id")).when(k == 5, F.concat(F.lit("(see "), "chunk_id", F.lit(")"))).when(k.isin(1, 6), F.concat(F.lit("as in ...:chunk:"), "suffix"))
        .when(k == 2, F.concat(F.lit("by `"), "suffix", F.lit("`"))).when(k == 4, F.concat(F.lit("see chunk_id: "), "chunk_id", F.lit("x"))).when(k == 7, F.concat(F.lit("as in ...:chunk:x"), "suffix")).otherwise("without a source")
    )
    answers = placed.groupBy("session_id", "mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x.s), ", ").alias("answer"))
    twins = placed.where(k == 6).select("session_id", F.concat("document_id", F.lit(":twin:chunk:"), "suffix").alias("chunk_id"))
    return placed, answers, placed.select("session_id", "chunk_id").unionByName(twins)


def citation_audit_all(spark: SparkSession, d: str) -> DataFrame:
    """By place and document a chunk is cited in full (0, 5), shortened (1, 2), not at all (3), by a wrong id (4, 7), or by a part that another chunk of the evidence shares (6)."""
    _, answers, evidence = _cited(spark, d)
    report = audit.citations(answers.drop("mode"), evidence)
    return report.select("session_id", "status", "citation_format", "full_id_compliant", F.size("valid").alias("valid"), F.size("invalid").alias("invalid"), F.size("ambiguous").alias("ambiguous"), "retrieved_chunks")


TOOL = "search_knowledge"


def session_logs(spark: SparkSession, d: str) -> DataFrame:
    """session, line_no, type, record of a log for each answer: an earlier turn, a call of another tool, and the turn to be judged.

    By mode the search failed (0), the turn was cut off (1), the result came twice (2), or its block names the call (3); in 4 usage isn't told.
    """
    _, answers, evidence = _cited(spark, d)
    found = evidence.groupBy("session_id").agg(F.to_json(F.struct(F.collect_list(F.struct("chunk_id")).alias("results"))).alias("payload"), F.count("*").alias("n"))  # RUN chunks and their twins
    s = answers.join(found, "session_id")
    mode = F.col("mode")
    text = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    data = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    call = lambda i, name: data(callId=F.lit(i), name=F.lit(name))
    block = F.struct(F.lit("tool-result").alias("type"), F.when(mode == 3, "c1").alias("toolCallId"), (mode == 0).alias("isError"), text(F.col("payload")).alias("content"))
    result = data(message=F.struct(F.when(mode != 3, F.struct(F.lit("c1").alias("callId"))).alias("source"), F.array(block).alias("content")))
    again = data(message=F.struct(F.struct(F.lit("c1").alias("callId")).alias("source"), F.array(F.struct(F.lit("tool-result").alias("type"), F.lit(False).alias("isError"), text(F.lit('{"results": [{"chunk_id": "z:chunk:z"}]}')).alias("content"))).alias("content")))
    thought = F.struct(F.lit("reasoning").alias("type"), F.lit("chunk_id: no:chunk:no").alias("text"))
    usage = F.when(mode != 4, F.struct(F.col("n").alias("inputTokens"), F.lit(7).alias("outputTokens")))
    last = data(message=F.struct(F.array_insert(text(F.col("answer")), 1, thought).alias("content")), usage=usage)
    old = data(message=F.struct(text(F.lit("see chunk_id: old:chunk:old")).alias("content")))
    end = lambda kind: data(reason=F.struct(kind.alias("kind")))
    lines = [
        ("user/message", data(content=text(F.lit("why")))), ("turn/start", data(turn=F.lit(1))), ("tool/call", call("c0", "web")), ("assistant/message", old), ("turn/end", end(F.lit("completed"))), ("turn/start", data(turn=F.lit(2))),
        ("tool/call", call("c1", TOOL)), ("tool/result", result), ("tool/result", F.when(mode == 2, again)), ("assistant/message", last), ("turn/end", end(F.when(mode == 1, "max-tokens").otherwise("completed"))),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("line_no"), F.lit(kind).alias("type"), body.alias("body")) for i, (kind, body) in enumerate(lines)])
    each = s.select(F.col("session_id").alias("session"), F.inline(F.filter(rows, lambda r: r.body.isNotNull())))
    return each.select("session", "line_no", "type", F.concat(F.lit('{"type":"'), "type", F.lit('","data":'), "body", F.lit("}")).alias("record"))


def session_audit(spark: SparkSession, d: str) -> DataFrame:
    report = audit.session_audit(materialize(session_logs(spark, d), "logs"), TOOL)
    sizes = [F.size(c).alias(c) for c in ("valid", "invalid", "ambiguous")]
    return report.select("session", "status", "citation_format", *sizes, "retrieved_chunks", "calls", "results", "result_records", "duplicates", "unparsed", "finish", "answer_present")


def session_grades(spark: SparkSession, d: str) -> DataFrame:
    graded = audit.session_grades(materialize(session_logs(spark, d), "logs"), TOOL)
    return graded.select("session", "tool_calls", "kb_calls", "kb_successes", "kb_triggered", "kb_completed", "finish", "prompt", "input_tokens", "output_tokens")


def evidence_of_calls(spark: SparkSession, d: str) -> DataFrame:
    """Results of the search tool by session: how many hits its readable records have, and distinct chunks."""
    hits = audit.tool_results(session_logs(spark, d).where("type = 'tool/result'"), "record", "session", "line_no")
    return hits.groupBy("session").agg(F.count("*").alias("hits"), F.count_distinct(F.get_json_object("result", "$.chunk_id")).alias("chunks"))


_SESSIONS_SQL = f"""
  c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_id) - 1 AS pos FROM {current_sql('knowledge_chunks', 'chunk_id')} WHERE document_id IS NOT NULL),
  k AS (SELECT concat(document_id, '#', pos // {RUN}) AS session, (pos + ascii(right(document_id, 1))) % 8 AS k, (pos // {RUN} + ascii(right(document_id, 1))) % 5 AS mode FROM c),
  n AS (SELECT session, mode, count(*) FILTER (k IN (0, 5)) AS nf, count(*) FILTER (k IN (1, 2)) AS ns, count(*) FILTER (k IN (4, 7)) AS ni, count(*) FILTER (k = 6) AS na, count(*) AS n FROM k GROUP BY 1, 2)"""
_ORDER = "(ts, event_id)"
QUERIES = {
    "last_turn": (last_turns, f"""
        WITH s AS (SELECT user_id, max({_ORDER}) FILTER (event_type = 'click') AS f FROM events GROUP BY 1)
        SELECT e.user_id AS session, count(*) AS rows_left, arg_max(event_id, {_ORDER}) AS last_event FROM events e JOIN s USING (user_id) WHERE f IS NULL OR {_ORDER} >= f GROUP BY 1"""),
    "session_metrics": (session_metrics, """
        WITH r AS (SELECT user_id, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'click') AS used, coalesce(bool_or(value > 50), false) AS good FROM events GROUP BY 1)
        SELECT count(*) AS logs, count(*) FILTER (done) AS completed, count(*) FILTER (done AND used) AS triggered, count(*) FILTER (done AND good) AS ok, round(CASE WHEN count(*) FILTER (done) > 0 THEN 100.0 * count(*) FILTER (done AND used) / count(*) FILTER (done) ELSE 0.0 END, 2) AS trigger_rate FROM r"""),
    "first_result_per_call": (first_results, f"""
        SELECT concat(user_id, ':', event_type) AS call, arg_min(event_id, {_ORDER}) AS event_id, count(*) - 1 AS duplicates FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"""),
    "unresolved_calls": (unresolved, "SELECT DISTINCT user_id AS session FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')"),
    "citation_audit": (citation_audit, f"""
        WITH c AS (SELECT * FROM {current_sql('knowledge_chunks', 'chunk_id')} WHERE document_id IS NOT NULL), n AS (SELECT document_id, count(*) AS retrieved_chunks FROM c GROUP BY 1),
        f AS (SELECT document_id, count(*) FILTER (chunk_index % 4 = 0) AS nf, count(*) FILTER (chunk_index % 4 IN (1, 2)) AS ns FROM c WHERE chunk_index < 3 GROUP BY 1)
        SELECT f.document_id AS session_id, CASE WHEN nf + ns > 0 THEN 'valid_id_present' ELSE 'missing_citation' END AS status, CASE WHEN nf > 0 AND ns > 0 THEN 'mixed' WHEN nf > 0 THEN 'full' WHEN ns > 0 THEN 'abbreviated' ELSE 'none' END AS citation_format,
          nf > 0 AND ns = 0 AS full_id_compliant, nf + ns AS valid, 0 AS invalid, 0 AS ambiguous, retrieved_chunks FROM f JOIN n USING (document_id)"""),
    "citation_audit_all": (citation_audit_all, f"""
        WITH c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_id) - 1 AS pos FROM {current_sql('knowledge_chunks', 'chunk_id')} WHERE document_id IS NOT NULL),
        k AS (SELECT concat(document_id, '#', pos // {RUN}) AS session_id, (pos + ascii(right(document_id, 1))) % 8 AS k FROM c),
        n AS (SELECT session_id, count(*) FILTER (k IN (0, 5)) AS nf, count(*) FILTER (k IN (1, 2)) AS ns, count(*) FILTER (k IN (4, 7)) AS ni, count(*) FILTER (k = 6) AS na, count(*) AS n FROM k GROUP BY 1)
        SELECT session_id, CASE WHEN ni + na > 0 THEN 'invalid_or_ambiguous_citation' WHEN nf + ns > 0 THEN 'valid_id_present' ELSE 'missing_citation' END AS status, CASE WHEN nf > 0 AND ns > 0 THEN 'mixed' WHEN nf > 0 THEN 'full' WHEN ns > 0 THEN 'abbreviated' ELSE 'none' END AS citation_format,
          nf > 0 AND ns = 0 AND ni + na = 0 AS full_id_compliant, nf + ns AS valid, ni AS invalid, na AS ambiguous, n + na AS retrieved_chunks FROM n"""),
    "session_audit": (session_audit, f"""
        WITH {_SESSIONS_SQL}
        SELECT session, CASE WHEN mode = 0 THEN 'incomplete_evidence_log' WHEN mode = 1 THEN 'incomplete_turn' WHEN ni + na > 0 THEN 'invalid_or_ambiguous_citation' WHEN nf + ns > 0 THEN 'valid_id_present' ELSE 'missing_citation' END AS status,
          CASE WHEN mode = 0 THEN 'none' WHEN nf > 0 AND ns > 0 THEN 'mixed' WHEN nf > 0 THEN 'full' WHEN ns > 0 THEN 'abbreviated' ELSE 'none' END AS citation_format,
          CASE WHEN mode = 0 THEN 0 ELSE nf + ns END AS valid, CASE WHEN mode = 0 THEN 0 ELSE ni END AS invalid, CASE WHEN mode = 0 THEN 0 ELSE na END AS ambiguous, CASE WHEN mode = 0 THEN 0 ELSE n + na END AS retrieved_chunks,
          1 AS calls, CASE WHEN mode = 0 THEN 0 ELSE 1 END AS results, CASE WHEN mode = 2 THEN 2 ELSE 1 END AS result_records, CASE WHEN mode IN (0, 2) THEN 1 ELSE 0 END AS duplicates, CASE WHEN mode = 0 THEN 1 ELSE 0 END AS unparsed,
          CASE WHEN mode = 1 THEN 'max-tokens' ELSE 'completed' END AS finish, true AS answer_present FROM n"""),
    "session_grades": (session_grades, f"""
        WITH {_SESSIONS_SQL}
        SELECT session, 2 AS tool_calls, 1 AS kb_calls, CASE WHEN mode = 0 THEN 0 ELSE 1 END AS kb_successes, true AS kb_triggered, mode <> 0 AS kb_completed, CASE WHEN mode = 1 THEN 'max-tokens' ELSE 'completed' END AS finish, 'why' AS prompt,
          CASE WHEN mode <> 4 THEN n + na END AS input_tokens, CASE WHEN mode <> 4 THEN 7 END AS output_tokens FROM n"""),
    "evidence_of_calls": (evidence_of_calls, f"""
        WITH {_SESSIONS_SQL} SELECT session, n + na + CASE WHEN mode = 2 THEN 1 ELSE 0 END AS hits, n + na + CASE WHEN mode = 2 THEN 1 ELSE 0 END AS chunks FROM n WHERE mode <> 0"""),
}
