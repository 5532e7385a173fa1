"""Raw keys, conversations, security and index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import epoch_to_timestamp, strip
from strataloom.operators import chunking, ingest
from strataloom.operators import security as sec
from strataloom.operators.current import file_row, row_version
from strataloom.operators.ranking import ordered_hash, positions
from strataloom.plans.corpus_plans import SPACE_SQL, current_sql, strip_sql
from strataloom.plans.tables import current, table
from strataloom.scratch import materialize
from strataloom.sources import index, raw_store

HIDDEN = "('thoughts', 'reasoning_recap', 'user_editable_context', 'model_editable_context')"
_TURNS_SQL = "(SELECT * FROM chat_turns QUALIFY row_number() OVER (PARTITION BY conversation_id, node_id ORDER BY arrived_at DESC) = 1)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    cols = ["parent", "role", "create_time", "content_type", "text", "recipient", "metadata"]
    return current(spark, d, "chat_turns", ["conversation_id", "node_id"], cols)


def visible() -> object:
    hidden = F.coalesce(F.get_json_object("metadata", "$.is_visually_hidden_from_conversation") == "true", F.lit(False))
    return (
        F.col("role").isin("user", "assistant") & ~hidden & F.coalesce(F.col("recipient").isin("", "all"), F.lit(True))
        & ~F.coalesce(F.col("content_type").isin("thoughts", "reasoning_recap", "user_editable_context", "model_editable_context"), F.lit(False))
        & (F.coalesce(strip(F.col("text")), F.lit("")) != "")
    )


_VISIBLE_SQL = f"""role IN ('user', 'assistant') AND coalesce(json_extract_string(metadata, '$.is_visually_hidden_from_conversation'), '') <> 'true' AND coalesce(recipient IN ('', 'all'), true)
  AND NOT coalesce(content_type IN {HIDDEN}, false) AND coalesce({strip_sql('text')}, '') <> ''"""


def raw_keys(spark: SparkSession, d: str) -> DataFrame:
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    key = raw_store.raw_key(F.lit("default"), F.coalesce("source", F.lit("")), sha, F.concat(F.coalesce("title", F.lit("")), F.lit(".MD")))
    kind = F.col("doc_id") % 5  # some keys are broken on purpose
    broken = F.when(kind == 1, F.concat(F.lit("/"), key)).when(kind == 2, F.replace(key, F.lit("/sources/"), F.lit("/../"))).when(kind == 3, F.replace(key, F.lit("/"), F.lit("\\"))).otherwise(key)
    return table(spark, d, "documents").select("doc_id", broken.alias("raw_key")).withColumn("valid", raw_store.valid_key(F.col("raw_key")))


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).where(visible()).groupBy("conversation_id", "role").agg(F.count("*").alias("turns"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Visible turns of each conversation in time order, as one hashed text, with their span. Turns of a conversation are hashed one after another as short digests."""
    said = F.unhex(F.sha2(F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), strip(F.col("text"))), 256))
    each = _messages(spark, d).where(visible()).select("conversation_id", "node_id", F.coalesce("create_time", F.lit(0.0)).alias("t"), said.alias("h"))
    hashed = ordered_hash(each, "conversation_id", "t", "node_id", "h")
    return hashed.select(F.col("g").alias("conversation_id"), F.col("hash").alias("transcript_hash"), F.col("n").alias("turns"), F.col("first_at").alias("first_time"), F.col("last_at").alias("last_time"))


def latest_leaf(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    parents = m.where("parent is not null").select("conversation_id", F.col("parent").alias("node_id")).distinct()
    leaves = m.join(parents, ["conversation_id", "node_id"], "left_anti")
    order = F.struct(F.coalesce("create_time", F.lit(float("-1e300"))).alias("t"), "node_id")
    return leaves.groupBy("conversation_id").agg(F.max(order)["node_id"].alias("leaf"), F.count("*").alias("leaves"))


def epochs(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    return m.select("conversation_id", "node_id", F.date_format(epoch_to_timestamp(F.col("create_time")), "yyyy-MM-dd HH:mm:ss.SSS").alias("created"))


def current_documents(spark: SparkSession, d: str) -> DataFrame:
    """Newest delivery of each document: what became of it. One aggregate of numbers finds the newest and counts all."""
    deliveries = table(spark, d, "norm_documents").withColumn("version", row_version(F.col("arrived_at"), file_row()))
    newest = deliveries.where("document_id is not null").groupBy("document_id").agg(F.max("version").alias("version"), F.count("*").alias("deliveries"))
    shown = deliveries.select("version", strip(F.col("title")).alias("title"), F.lower("domain").alias("domain"), "project", F.length("content").cast("long").alias("n_chars"))
    return shown.join(newest, "version").drop("version")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return sec.scannable_fields(table(spark, d, "documents"), "doc_id", {"content": "text", "title": "title"})


def findings_of(detector: sec.Detector):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = sec.findings(_fields(spark, d), "doc_id", sec.Policy(detectors=(detector,)))
        return found.groupBy("doc_id", "field_path", "category", "action").agg(F.count("*").alias("findings"), F.countDistinct("evidence_hash").alias("different"))

    return run


def secret_findings(spark: SparkSession, d: str) -> DataFrame:
    """Credentials in current documents' content and title, by line: their places aren't told."""
    docs = current(spark, d, "norm_documents", ["document_id"], ["content", "title"])
    found = sec.findings(sec.scannable_fields(docs, "document_id", {"content": "content", "title": "title"}), "document_id", sec.Policy(detectors=(sec.SECRET, sec.PRIVATE_KEY, sec.CLOUD_KEY)))
    return found.select("document_id", "field_path", "category", "action", F.col("line_number").cast("long").alias("line_number"), "evidence_hash")


def scan_decision(spark: SparkSession, d: str) -> DataFrame:
    found = sec.findings(_fields(spark, d), "doc_id", sec.Policy(detectors=(sec.SECRET, sec.EMAIL, sec.CARD)))
    return sec.decisions(table(spark, d, "documents"), found, "doc_id").withColumn("categories", F.array_join("categories", ","))


def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return scan_decision(spark, d).groupBy("decision").agg(F.count("*").alias("documents"), F.sum("finding_count").alias("findings"))


def document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Decision on each current document: all scanned fields under the default policy."""
    cols = ["content", "title", "author", "metadata", F.col("source.metadata").alias("source_metadata")]
    docs = materialize(current(spark, d, "norm_documents", ["document_id"], cols), "documents")
    found = sec.findings(sec.document_fields(docs), "document_id")
    return sec.decisions(docs, found, "document_id").withColumn("categories", F.array_join("categories", ","))


def redact_email(spark: SparkSession, d: str) -> DataFrame:
    """Texts without their e-mail addresses; a new hash where one was replaced."""
    docs = table(spark, d, "documents").where("text is not null")
    clean = docs.select("doc_id", "text", sec.redact(F.col("text"), (sec.EMAIL,)).alias("clean"))
    return clean.select("doc_id", (F.col("clean") != F.col("text")).alias("redacted"), F.sha2("clean", 256).alias("content_hash"))


def with_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents with numbers behind them that look like cards; of one in ten the check digit is right."""
    n = lambda x, m: F.lpad(F.pmod(F.col("doc_id") * x, F.lit(m)).cast("string"), len(str(m)) - 1, "0")
    card = F.concat(F.lit("4"), n(7919, 1000), F.lit(" "), n(104729, 10000), F.lit(" "), n(1299709, 10000), F.lit(" "), n(15485863, 10000))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" acct 9"), card, F.lit(" card "), card, F.lit("; "), card).alias("text"))


def redact_card(spark: SparkSession, d: str) -> DataFrame:
    """Valid card numbers replaced; what only looks like one stays."""
    clean = with_numbers(spark, d).select("doc_id", "text", sec.redact(F.col("text"), (sec.VALID_CARD,)).alias("clean"))
    return clean.select("doc_id", (F.col("clean") != F.col("text")).alias("redacted"), F.sha2("clean", 256).alias("content_hash"))


def redact_ip(spark: SparkSession, d: str) -> DataFrame:
    """Private addresses replaced where they stand alone, in texts with addresses of both kinds behind them."""
    b = F.pmod(F.col("doc_id"), F.lit(256)).cast("string")
    docs = table(spark, d, "documents").where("text is not null")
    text = F.concat("text", F.lit(" build v10.0.0."), b, F.lit(" host 10.0.0."), b, F.lit(" up, 8.8.8."), b, F.lit(" and 10.1.2.3."), b)
    clean = docs.select("doc_id", text.alias("text")).select("doc_id", "text", sec.redact(F.col("text"), (sec.BOUND_IPV4,)).alias("clean"))
    return clean.select("doc_id", (F.col("clean") != F.col("text")).alias("redacted"), F.right("clean", F.lit(70)).alias("tail"))


#: What the ingest queries scan for: patterns that SQL can say too, in content and title; mentions of persons' addresses are replaced, credentials block.
INGEST_POLICY = sec.Policy(pii="redact", detectors=(sec.SECRET, sec.PRIVATE_KEY, sec.EMAIL), author=False, metadata=False, source_metadata=False)


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "norm_documents", ["document_id"], ["title", "content", "source", "domain", "project", "author", "metadata", F.col("source.metadata").alias("source_metadata"), "content_hash", "security"])


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return materialize(sec.scan(materialize(_normalized(spark, d), "normalized"), INGEST_POLICY), "scanned")


def redact_pii(spark: SparkSession, d: str) -> DataFrame:
    """Documents after the scan: decision, and content and title without e-mail addresses; a new hash where the content changed."""
    return _scanned(spark, d).select("document_id", "decision", "redacted", "content_hash", F.sha2("title", 256).alias("title_hash"))


def sensitive_categories(spark: SparkSession, d: str) -> DataFrame:
    s = _scanned(spark, d).select("document_id", "security")
    return s.select("document_id", F.col("security.contains_sensitive_data").alias("sensitive"), F.array_join(F.array_sort("security.sensitive_categories"), ",").alias("categories"))


def accepted_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Documents, accepted and blocked ones by project, with the findings."""
    return _scanned(spark, d).groupBy("project").agg(F.count("*").alias("documents"), F.count_if(F.col("decision") != "block").alias("accepted"), F.count_if(F.col("decision") == "block").alias("blocked"), F.sum("finding_count").alias("findings"))


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The ingest run over the current documents: of each its decision, whether it has chunks and index rows, and that none exceeds the limit."""
    done = ingest.ingest_documents(materialize(_normalized(spark, d), "normalized"), config=ingest.IngestConfig(policy=INGEST_POLICY))
    chunks = done.chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.max("token_count").alias("most"))
    rows = done.rows.groupBy("document_id").agg(F.count("*").alias("indexed"))
    out = done.documents.select("document_id", "decision").join(chunks, "document_id", "left").join(rows, "document_id", "left")
    return out.select("document_id", "decision", F.coalesce(F.col("n") > 0, F.lit(False)).alias("chunked"), (F.coalesce("n", F.lit(0)) == F.coalesce("indexed", F.lit(0))).alias("all_indexed"), F.coalesce(F.col("most") <= 512, F.lit(True)).alias("within_limit"))


def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every string in the metadata of the current documents, at any depth, with its path."""
    docs = current(spark, d, "norm_documents", ["document_id"], ["metadata"])
    return sec.nested_fields(docs, "document_id", "metadata").select("document_id", "field_path", F.sha2("text", 256).alias("text_hash"))


def auto_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all current documents: conversations by their visible turns in time order, the others by structure."""
    docs = current(spark, d, "norm_documents", ["document_id"], ["content", F.col("source.source_type").alias("source_type"), F.col("source.source_id").alias("source_id")])
    owner = docs.where("source_type = 'conversation'").select("document_id", F.col("source_id").alias("conversation_id"))
    said = _messages(spark, d).where(visible()).select("conversation_id", "node_id", F.coalesce("create_time", F.lit(0.0)).alias("t"), F.col("role").alias("speaker"), "text")
    turns = positions(said.join(owner, "conversation_id").drop("conversation_id"), "document_id", ["t", "node_id"], "turn_pos")
    chunks = chunking.chunk_all(docs, turns, conv="document_id")
    return chunks.select("document_id", "chunk_id", "chunk_index", "strategy", "conversation_fallback", "token_count", F.sha2("text", 256).alias("text_hash"))


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    cols = ["document_id", "chunk_index", "text", "source", "title", "section_path", "token_count", "domain", "project", "security"]
    rows = index.index_rows(current(spark, d, "knowledge_chunks", ["chunk_id"], cols))
    return rows.select("chunk_id", "document_id", F.sha2("text", 256).alias("text_hash"), "tenant_id", "domain", "project", "classification", "source_type", "provider", "source_id")


def pairing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and vector records by document: chunked, indexed, without record, of no chunk."""
    chunks = current(spark, d, "knowledge_chunks", ["chunk_id"], [F.col("document_id").alias("chunk_doc")])
    records = current(spark, d, "chunk_records", ["chunk_id"], [F.col("document_id").alias("record_doc")])
    both = chunks.join(records, "chunk_id", "full").withColumn("document_id", F.coalesce("chunk_doc", "record_doc"))
    return both.groupBy("document_id").agg(F.count("chunk_doc").alias("chunked"), F.count("record_doc").alias("indexed"), F.count_if(F.col("record_doc").isNull()).alias("unindexed"), F.count_if(F.col("chunk_doc").isNull()).alias("orphaned"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Records of one half upserted into the others: counts by side."""
    rec = current(spark, d, "chunk_records", ["chunk_id"], ["document_id", "project"]).withColumn("side", F.lit("old"))
    new = rec.where("project < 'm'").withColumn("side", F.lit("new"))
    merged = index.upsert(rec, new)
    return merged.groupBy("project", "side").agg(F.count("*").alias("records"), F.countDistinct("chunk_id").alias("ids"))


def _finding_sql(pattern: str, category: str, action: str, passes: str = "true") -> str:
    one = "SELECT * FROM (SELECT doc_id, '{0}' AS field_path, unnest(regexp_extract_all({1}, '{2}')) AS v FROM documents WHERE {1} <> '') WHERE " + passes
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, field_path, '{category}' AS category, '{action}' AS action, count(*) AS findings, count(DISTINCT v) AS different FROM ({one.format('content', 'text', p)} UNION ALL {one.format('title', 'title', p)}) GROUP BY 1, 2"


def _count_sql(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{pattern.replace(chr(39), chr(39) * 2)}'))"


#: Secrets are known by line and hash alone: equal ones on one line are one finding.
_SECRET_SQL = "(SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, f, i, v FROM (SELECT doc_id, f, i, unnest(regexp_extract_all(line, '{p}')) AS v FROM (SELECT doc_id, 'c' AS f, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents UNION ALL SELECT doc_id, 't', unnest(string_split(title, chr(10))), generate_subscripts(string_split(title, chr(10)), 1) FROM documents))) GROUP BY 1)".format(p=sec.SECRET.pattern.replace("'", "''"))
_DECISION_SQL = f"""
  SELECT doc_id, CASE WHEN s > 0 THEN 'block' WHEN e + c > 0 THEN 'mark' ELSE 'allow' END AS decision, s + e + c AS finding_count,
    concat_ws(',', CASE WHEN c > 0 THEN 'pii:credit_card' END, CASE WHEN e > 0 THEN 'pii:email_address' END, CASE WHEN s > 0 THEN 'secret:credential_assignment' END) AS categories
  FROM (SELECT d.doc_id, coalesce(x.n, 0) AS s, {_count_sql('text', sec.EMAIL.pattern)} + {_count_sql('title', sec.EMAIL.pattern)} AS e, {_count_sql('text', sec.CARD.pattern)} + {_count_sql('title', sec.CARD.pattern)} AS c FROM documents d LEFT JOIN {_SECRET_SQL} x ON x.doc_id = d.doc_id)"""
_LUHN_SQL = "list_sum([CASE WHEN i % 2 = 1 THEN x ELSE x * 2 - CASE WHEN x > 4 THEN 9 ELSE 0 END END FOR x, i IN [CAST(c AS INT) FOR c IN string_split(reverse(regexp_replace({0}, '[^0-9]', '', 'g')), '')]]) % 10 = 0"
_NUMBERS_SQL = "concat('4', lpad(CAST((doc_id * 7919) % 1000 AS VARCHAR), 3, '0'), ' ', lpad(CAST((doc_id * 104729) % 10000 AS VARCHAR), 4, '0'), ' ', lpad(CAST((doc_id * 1299709) % 10000 AS VARCHAR), 4, '0'), ' ', lpad(CAST((doc_id * 15485863) % 10000 AS VARCHAR), 4, '0'))"
_OCTETS_SQL = "list_bool_and([CAST(x AS BIGINT) <= 255 AND (len(x) = 1 OR x[1] <> '0') FOR x IN string_split(v, '.')])"


def _scanned_sql() -> str:
    """document_id, project, security, decision, findings, clean content and title, hash, e-mail and secret counts, as INGEST_POLICY has it."""
    mail, secrets = sec.EMAIL.pattern, [(sec.SECRET, "s"), (sec.PRIVATE_KEY, "k")]
    each = " UNION ALL ".join(f"SELECT document_id, '{f}' AS f, unnest(string_split({f}, chr(10))) AS line, generate_subscripts(string_split({f}, chr(10)), 1) AS i FROM c" for f in ("content", "title"))
    lines = ", ".join("{0} AS (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT document_id, f, i, v FROM (SELECT document_id, f, i, unnest(regexp_extract_all(line, '{1}')) AS v FROM l)) GROUP BY 1)".format(n, d.pattern.replace("'", "''")) for d, n in secrets)
    return f"""
      c AS (SELECT * FROM {current_sql('norm_documents', 'document_id')}), l AS ({each}), {lines},
      x AS (SELECT c.*, coalesce(s.n, 0) AS ns, coalesce(k.n, 0) AS nk, {_count_sql('content', mail)} + {_count_sql('title', mail)} AS ne, regexp_replace(content, '{mail}', '[PII:EMAIL_ADDRESS]', 'g') AS clean, regexp_replace(title, '{mail}', '[PII:EMAIL_ADDRESS]', 'g') AS clean_title
        FROM c LEFT JOIN s ON s.document_id = c.document_id LEFT JOIN k ON k.document_id = c.document_id),
      r AS (SELECT *, CASE WHEN ns + nk > 0 THEN 'block' WHEN ne > 0 THEN 'redact' ELSE 'allow' END AS decision FROM x)"""


_SEG = "coalesce(nullif(left(trim(regexp_replace({0}, '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), 96), ''), '{1}')"
QUERIES = {
    "raw_object_key": (raw_keys, f"""
        SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN concat('/', k) WHEN 2 THEN replace(k, '/sources/', '/../') WHEN 3 THEN replace(k, '/', chr(92)) ELSE k END AS raw_key, doc_id % 5 IN (0, 4) AS valid
        FROM (SELECT doc_id, concat('tenants/default/sources/', {_SEG.format("coalesce(source, '')", 'source')}, '/', left(h, 2), '/', h, '/', {_SEG.format("coalesce(title, '')", 'file')}, '.md') AS k FROM (SELECT *, sha256(coalesce(text, '')) AS h FROM documents))"""),
    "conv_role_counts": (role_counts, f"SELECT conversation_id, role, count(*) AS turns FROM {_TURNS_SQL} WHERE {_VISIBLE_SQL} GROUP BY 1, 2"),
    "conv_transcript": (transcripts, f"""
        SELECT conversation_id, sha256(string_agg(h, chr(10) ORDER BY t, node_id)) AS transcript_hash, count(*) AS turns, min(t) AS first_time, max(t) AS last_time
        FROM (SELECT conversation_id, node_id, coalesce(create_time, 0.0) AS t, sha256(concat('## ', upper(left(role, 1)), substr(role, 2), chr(10), chr(10), {strip_sql('text')})) AS h FROM {_TURNS_SQL} WHERE {_VISIBLE_SQL}) GROUP BY 1"""),
    "latest_leaf": (latest_leaf, f"""
        WITH t AS (SELECT * FROM {_TURNS_SQL}) SELECT conversation_id, arg_max(node_id, (coalesce(create_time, -1e300), node_id)) AS leaf, count(*) AS leaves
        FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.conversation_id = t.conversation_id AND p.parent = t.node_id) GROUP BY 1"""),
    "epoch_normalise": (epochs, f"""
        SELECT conversation_id, node_id, strftime(make_timestamp(CAST(round(CASE WHEN abs(create_time) >= 1e11 THEN create_time * 1000.0 ELSE create_time * 1e6 END) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%g') AS created FROM {_TURNS_SQL}"""),
    "current_documents": (current_documents, f"""
        SELECT c.document_id, {strip_sql('title')} AS title, lower(domain) AS domain, project, length(content) AS n_chars, deliveries
        FROM {current_sql('norm_documents', 'document_id')} c JOIN (SELECT document_id, count(*) AS deliveries FROM norm_documents GROUP BY 1) n ON n.document_id = c.document_id"""),
    "pii_findings_email": (findings_of(sec.EMAIL), _finding_sql(sec.EMAIL.pattern, "pii:email_address", "mark")),
    "pii_findings_card": (findings_of(sec.CARD), _finding_sql(sec.CARD.pattern, "pii:credit_card", "mark")),
    "context_findings_path": (findings_of(sec.UNIX_PATH), _finding_sql(sec.UNIX_PATH.pattern, "context:local_path", "mark")),
    "secret_findings": (secret_findings, "SELECT DISTINCT document_id, field_path, category, 'block' AS action, i AS line_number, sha256(v) AS evidence_hash FROM (" + " UNION ALL ".join(
        f"SELECT document_id, field_path, 'secret:{x.name}' AS category, i, unnest(regexp_extract_all(line, '{x.pattern.replace(chr(39), chr(39) * 2)}')) AS v FROM (SELECT document_id, '{f}' AS field_path, unnest(string_split({f}, chr(10))) AS line, generate_subscripts(string_split({f}, chr(10)), 1) AS i FROM {current_sql('norm_documents', 'document_id')})"
        for f in ("content", "title") for x in (sec.SECRET, sec.PRIVATE_KEY, sec.CLOUD_KEY)) + ")"),
    "scan_decision": (scan_decision, _DECISION_SQL),
    "scan_summary": (scan_summary, f"SELECT decision, count(*) AS documents, sum(finding_count) AS findings FROM ({_DECISION_SQL}) GROUP BY 1"),
    "document_scan": (document_scan, None),
    "pii_findings_phone": (findings_of(sec.PHONE), _finding_sql(sec.PHONE.pattern, "pii:phone_number", "mark")),
    "pii_findings_ip": (findings_of(sec.IP), _finding_sql(sec.IP.pattern, "pii:ip_address", "mark", _OCTETS_SQL)),
    "redact_card": (redact_card, f"""
        SELECT doc_id, clean <> text AS redacted, sha256(clean) AS content_hash FROM (
          SELECT doc_id, text, array_to_string([concat(gaps[i], coalesce(CASE WHEN {_LUHN_SQL.format('hits[i]')} THEN '[PII:CREDIT_CARD]' ELSE hits[i] END, '')) FOR i IN range(1, len(gaps) + 1)], '') AS clean
          FROM (SELECT *, regexp_split_to_array(text, '{sec.CARD.pattern}') AS gaps, regexp_extract_all(text, '{sec.CARD.pattern}') AS hits FROM (SELECT doc_id, concat(text, ' acct 9', n, ' card ', n, '; ', n) AS text FROM (SELECT doc_id, text, {_NUMBERS_SQL} AS n FROM documents WHERE text IS NOT NULL))))"""),
    "redact_ip": (redact_ip, None),
    "redact_pii": (redact_pii, f"""
        WITH {_scanned_sql()} SELECT document_id, decision, ne > 0 AS redacted, CASE WHEN clean <> content THEN sha256(clean) ELSE content_hash END AS content_hash, sha256(clean_title) AS title_hash FROM r"""),
    "sensitive_categories": (sensitive_categories, f"""
        WITH {_scanned_sql()}, n AS (SELECT document_id, coalesce(security.contains_sensitive_data, false) OR decision <> 'allow' AS sensitive, coalesce(security.sensitive_categories, []) AS old,
          list_filter([CASE WHEN ne > 0 THEN 'pii:email_address' END, CASE WHEN ns > 0 THEN 'secret:credential_assignment' END, CASE WHEN nk > 0 THEN 'secret:private_key' END], lambda x: x IS NOT NULL) AS new FROM r)
        SELECT document_id, sensitive, array_to_string(list_sort(list_distinct(list_concat(old, new))), ',') AS categories FROM n"""),
    "accepted_blocked_counts": (accepted_blocked, f"""
        WITH {_scanned_sql()} SELECT project, count(*) AS documents, count(*) FILTER (decision <> 'block') AS accepted, count(*) FILTER (decision = 'block') AS blocked, sum(ns + nk + ne) AS findings FROM r GROUP BY 1"""),
    "ingest_outcomes": (ingest_outcomes, f"""
        WITH {_scanned_sql()} SELECT document_id, decision, decision <> 'block' AND coalesce({strip_sql('content')}, '') <> '' AS chunked, true AS all_indexed, true AS within_limit FROM r"""),
    "redact_email": (redact_email, f"""
        SELECT doc_id, clean <> text AS redacted, sha256(clean) AS content_hash FROM (SELECT doc_id, text, regexp_replace(text, '{sec.EMAIL.pattern}', '[PII:EMAIL_ADDRESS]', 'g') AS clean FROM documents WHERE text IS NOT NULL)"""),
    "auto_chunks": (auto_chunks, None),
    "metadata_fields": (metadata_fields, f"""
        SELECT document_id, replace(concat('metadata', substr(fullkey, 2)), '"', '') AS field_path, sha256(json_extract_string(atom, '$')) AS text_hash
        FROM {current_sql('norm_documents', 'document_id')} n, json_tree(CASE WHEN json_valid(n.metadata) THEN n.metadata END) t
        WHERE t.type = 'VARCHAR' AND json_extract_string(atom, '$') <> '' AND lower(regexp_extract(fullkey, '([^.\\[\\]"]+)"?(\\[[0-9]+\\])*$', 1)) NOT IN ({", ".join(f"'{k}'" for k in sec.OPERATIONAL_KEYS)})"""),
    "index_rows": (index_rows, f"""
        SELECT chunk_id, document_id, sha256(text) AS text_hash, coalesce(security.tenant_id, 'default') AS tenant_id, coalesce(domain, '') AS domain, coalesce(project, '') AS project, coalesce(security.classification, 'internal') AS classification,
          coalesce(source.source_type, '') AS source_type, coalesce(source.provider, '') AS provider, coalesce(source.source_id, '') AS source_id FROM {current_sql('knowledge_chunks', 'chunk_id')}"""),
    "chunk_vector_pairing": (pairing, f"""
        SELECT coalesce(c.document_id, r.document_id) AS document_id, count(c.document_id) AS chunked, count(r.document_id) AS indexed, count(*) FILTER (r.document_id IS NULL) AS unindexed, count(*) FILTER (c.document_id IS NULL) AS orphaned
        FROM {current_sql('knowledge_chunks', 'chunk_id')} c FULL JOIN {current_sql('chunk_records', 'chunk_id')} r ON r.chunk_id = c.chunk_id GROUP BY 1"""),
    "upsert_merge": (upserted, f"""
        SELECT project, CASE WHEN project < 'm' THEN 'new' ELSE 'old' END AS side, count(*) AS records, count(DISTINCT chunk_id) AS ids FROM {current_sql('chunk_records', 'chunk_id')} GROUP BY 1, 2"""),
}
