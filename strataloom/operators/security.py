"""Security scan: fields, findings, decision, redaction, summary.

Detectors are patterns over text columns and can be replaced; what the engine
settles is the policy: each kind of finding has an action, a document's decision
is its gravest action, and only findings with a span can be redacted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.network import ipv4_number, is_private_ipv4
from strataloom.functions.text import slug
from strataloom.scratch import materialize

# Actions in rising gravity; metadata keys that are provenance and aren't scanned; directories below which a path is local.
ACTIONS = ["allow", "mark", "redact", "block"]
OPERATIONAL_KEYS = (
    "content_hash", "conversion_status", "created_at", "current_node", "docling_document_name", "document_id", "extension", "filename", "format", "hash", "id",
    "message_id", "mime_type", "parent_id", "provider", "raw_sha256", "raw_size_bytes", "raw_uri", "sha256", "source_id", "source_type", "updated_at",
)
LOCAL_ROOTS = ("dev", "etc", "home", "mnt", "opt", "root", "srv", "tmp", "var", "workspace")


@dataclass(frozen=True)
class Detector:
    """``kind``: secret, pii or context. ``pattern``: never matches nothing; RE2-compatible, without look-around, where a query has a SQL twin.

    ``check``: what a match must pass besides: private (an address of a private network), luhn, entropy (as random as a key).
    ``context``: a pattern that the match's line must have. ``span``: whether it can be redacted. ``score``: how sure a match is.
    """

    name: str
    kind: str
    pattern: str
    span: bool = True
    check: str = ""
    context: str = ""
    score: float = 1.0


_NAMED = r"(?:pass(?:word|phrase|wd)|secret|token|(?:api|access|private|signing)[ _-]?key|credentials?)"
SECRET = Detector("credential_assignment", "secret", rf"(?i)\b[a-z0-9_-]*{_NAMED}" + r"[\"']?[ \t]*(?::|=|:=|=>)[ \t]*[\"']?[a-z0-9+/_.~!@#$%^&*-]{6,}", span=False)
BEARER = Detector("bearer_token", "secret", r"(?i)\bbearer[ \t]+[a-z0-9._~+/-]{16,}=*", span=False)
PRIVATE_KEY = Detector("private_key", "secret", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", span=False)
CLOUD_KEY = Detector("cloud_key_id", "secret", r"\b(?:AKIA|ASIA)[A-Z2-7]{16}\b", span=False)
RANDOM_STRING = Detector("high_entropy_string", "secret", r"[A-Za-z0-9+/_=-]{20,}", span=False, check="entropy", context=rf"(?i){_NAMED}|\bauth|\bbearer")
EMAIL = Detector("email_address", "pii", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
CARD = Detector("credit_card", "pii", r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b")
VALID_CARD = replace(CARD, check="luhn")
PHONE = Detector("phone_number", "pii", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b", score=0.6)
IP = Detector("ip_address", "pii", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", check="ipv4", score=0.6)
IPV4 = Detector("internal_ip", "context", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", check="private")
UNIX_PATH = Detector("local_path", "context", rf"/(?:{'|'.join(LOCAL_ROOTS)})/[^\s\"'`<>()\[\]{{}}]+")
# The default policy's own forms of the context patterns, with boundaries that only the JVM's patterns can say.
BOUND_IPV4 = replace(IPV4, pattern=r"(?U)(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])")
BOUND_UNIX_PATH = replace(UNIX_PATH, pattern=r"(?U)(?<!\w)" + UNIX_PATH.pattern)
WINDOWS_PATH = Detector("local_path", "context", r"(?U)\b[A-Za-z]:(?:\\[^\\\s<>:\"|?*]+)+\\?")
DETECTORS = (SECRET, BEARER, PRIVATE_KEY, CLOUD_KEY, RANDOM_STRING, EMAIL, VALID_CARD, BOUND_IPV4, BOUND_UNIX_PATH, WINDOWS_PATH)


@dataclass(frozen=True)
class Policy:
    """An action for each kind; ``detectors``; ``min_score``: of matches that count; ``title``, ``author``, ``metadata``, ``source_metadata``: whether these are scanned besides the content."""

    secret: str = "block"
    pii: str = "mark"
    context: str = "mark"
    detectors: tuple[Detector, ...] = field(default=DETECTORS)
    min_score: float = 0.5
    title: bool = True
    author: bool = True
    metadata: bool = True
    source_metadata: bool = True

    def __post_init__(self) -> None:
        if any(a not in ACTIONS for a in (self.secret, self.pii, self.context)):
            raise ValueError(f"actions are {ACTIONS}")
        if self.secret == "redact":
            raise ValueError("secrets have no span and can't be redacted")

    def action(self, kind: Column) -> Column:
        return F.when(kind == "secret", self.secret).when(kind == "pii", self.pii).otherwise(self.context)

    def used(self) -> tuple[Detector, ...]:
        return tuple(d for d in self.detectors if d.score >= self.min_score)

    def redacting(self) -> tuple[Detector, ...]:
        """Detectors whose matches are replaced."""
        return tuple(d for d in self.used() if d.span and {"pii": self.pii, "context": self.context}.get(d.kind) == "redact")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` have a right check digit."""
    digits = F.reverse(F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda x: x.cast("int")))
    doubled = F.transform(F.filter(digits, lambda x: x.isNotNull()), lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def _passes(value: Column, check: str) -> Column:
    if check == "private":
        return F.coalesce(is_private_ipv4(value), F.lit(False))
    if check == "ipv4":
        return ipv4_number(value).isNotNull()
    if check == "luhn":
        return luhn(value)
    if check == "entropy":
        return entropy(value) >= F.when(value.rlike("^[0-9a-fA-F]+$"), 3.0).otherwise(4.3)
    raise ValueError(f"unknown check {check!r}")


def matches(text: Column, d: Detector) -> Column:
    """array<struct<start, end, line, value>>, in code points; lines count from 1. What lies between the matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    lengths = F.arrays_zip(F.transform(F.split(text, d.pattern, -1), lambda g: F.struct(F.length(g).alias("n"), breaks(g).alias("lines"))).alias("gap"), found.alias("value"))
    state = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.expr("cast(array() as array<struct<start: int, end: int, line: int, value: string>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start, line = s.at + x.gap.n, s.line + x.gap.lines
        end = start + F.length(x.value)
        hit = F.struct(start.alias("start"), end.alias("end"), line.alias("line"), x.value.alias("value"))
        return F.struct(end.alias("at"), (line + breaks(x.value)).alias("line"), F.concat(s.out, F.array(hit)).alias("out"))

    # The last gap has no match behind it.
    spans = F.aggregate(F.filter(lengths, lambda x: x.value.isNotNull()), state, step, lambda s: s.out)
    if d.check:
        spans = F.filter(spans, lambda x: _passes(x.value, d.check))
    if d.context:
        lines = F.split(text, "\n")
        spans = F.filter(spans, lambda x: F.element_at(lines, x.line).rlike(d.context))
    return spans


def scannable_fields(docs: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """id, field_path, text: one row a field with text. ``columns``: field path -> column. Operational keys are left out."""
    wanted = {p: c for p, c in columns.items() if p.rpartition(".")[2].lower() not in OPERATIONAL_KEYS}
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("field_path"), F.col(c).cast("string").alias("text")) for p, c in wanted.items()]))
    return docs.select(id_col, rows.alias("f")).select(id_col, "f.field_path", "f.text").where("text <> ''")


def json_fields(docs: DataFrame, id_col: str, column: str, prefix: str = "metadata") -> DataFrame:
    """String leaves one level down in a JSON object column, operational keys left out: id, field_path, text."""
    m = F.from_json(F.col(column), "map<string,string>")
    rows = docs.select(id_col, F.explode(m).alias("key", "text"))
    return rows.where(~F.lower("key").isin(*OPERATIONAL_KEYS) & (F.col("text") != "")).select(id_col, F.concat(F.lit(prefix + "."), "key").alias("field_path"), "text")


def _leaves(value: object, path: str = "") -> Iterator[tuple[str, str, str]]:
    """(path, last key, text) of every string that isn't empty, in order: a.b[0].c."""
    todo = [(path, "", value)]
    while todo:
        at, key, v = todo.pop()
        if isinstance(v, str):
            if v:
                yield at, key, v
        elif isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{at}[{i}]", key, x) for i, x in reversed(list(enumerate(v)))]


def _json(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def nested_fields(docs: DataFrame, id_col: str, column: str, prefix: str = "metadata") -> DataFrame:
    """id, field_path, text of every string leaf of a JSON column at any depth, operational keys left out. What is no JSON gives none."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, path, text) for i, t in zip(b["i"], b["t"]) for path, key, text in _leaves(_json(t), prefix) if key.lower() not in OPERATIONAL_KEYS]
            yield pd.DataFrame(rows, columns=["i", "field_path", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(column).alias("t")).mapInPandas(walk, f"i {kind}, field_path string, text string").withColumnRenamed("i", id_col)


def document_fields(docs: DataFrame, id_col: str = "document_id", policy: Policy = Policy()) -> DataFrame:
    """id, field_path, text of all that is scanned: content, and as the policy says title, author, and the leaves of metadata and source_metadata (JSON)."""
    wanted = ["content", *(["title"] if policy.title else []), *(["author"] if policy.author else [])]
    out = scannable_fields(docs, id_col, {c: c for c in wanted})
    if policy.metadata:
        out = out.unionByName(nested_fields(docs, id_col, "metadata"))
    if policy.source_metadata:
        out = out.unionByName(nested_fields(docs, id_col, "source_metadata", "source.metadata"))
    return out


def put_fields(docs: DataFrame, changed: DataFrame, id_col: str, column: str, prefix: str = "metadata") -> DataFrame:
    """``docs`` with the string leaves of a JSON column replaced by ``changed`` (id, field_path, text); other rows and leaves stay.

    Ids of documents are unique; of several changes of one leaf the greatest text holds.
    """
    one = changed.groupBy(id_col, "field_path").agg(F.max("text").alias("text"))
    maps = one.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("field_path", "text"))).alias("_changed"))

    @F.pandas_udf("string")
    def put(text: pd.Series, change: pd.Series) -> pd.Series:
        def rebuilt(v: object, at: str, new: dict[str, str]) -> object:
            if isinstance(v, str):
                return new.get(at, v)
            if isinstance(v, dict):
                return {k: rebuilt(x, f"{at}.{k}" if at else k, new) for k, x in v.items()}
            return [rebuilt(x, f"{at}[{i}]", new) for i, x in enumerate(v)] if isinstance(v, list) else v

        return pd.Series([json.dumps(rebuilt(v, prefix, dict(c)), ensure_ascii=False) if (v := _json(t)) is not None else t for t, c in zip(text, change)], dtype=object)

    both = docs.join(maps, id_col, "left")
    return both.withColumn(column, F.when(F.col("_changed").isNotNull(), put(F.col(column), F.coalesce("_changed", F.expr("cast(map() as map<string, string>)")))).otherwise(F.col(column))).select(docs.columns)


def findings(fields: DataFrame, id_col: str, policy: Policy = Policy()) -> DataFrame:
    """One row a distinct finding: id, field_path, kind, category, detector, score, action, line_number, start, end (null without a span), evidence_hash."""
    text = F.col("text")

    def rows_of(d: Detector) -> Column:
        def row(x: Column) -> Column:
            return F.struct(
                F.lit(d.kind).alias("kind"), F.concat(F.lit(d.kind + ":"), slug(F.lit(d.name))).alias("category"), F.lit(d.name).alias("detector"), F.lit(d.score).alias("score"),
                F.when(F.lit(d.span), x.start).alias("start"), F.when(F.lit(d.span), x.end).alias("end"), x.line.alias("line_number"), F.sha2(x.value, 256).alias("evidence_hash"),
            )

        return F.transform(matches(text, d), row)

    each = F.concat(*[rows_of(d) for d in policy.used()])
    rows = fields.select(id_col, "field_path", F.explode_outer(each).alias("x")).where("x is not null")
    return rows.select(id_col, "field_path", "x.*").dropDuplicates([id_col, "field_path", "category", "start", "end", "line_number", "evidence_hash"]).withColumn("action", policy.action(F.col("kind")))


def well_formed(found: DataFrame, fields: DataFrame, id_col: str) -> DataFrame:
    """Findings of an outside detector that have no span, or one that lies in their field: 0 <= start <= end <= length, as whole numbers however they are written."""
    whole = lambda c: F.col(c).cast("string").try_cast("double").try_cast("int")
    cast = found.withColumn("_none", F.col("start").isNull() & F.col("end").isNull()).withColumns({"start": whole("start"), "end": whole("end")})
    sized = cast.join(fields.select(id_col, "field_path", F.length("text").alias("_size")), [id_col, "field_path"])
    return sized.where("_none or (start >= 0 and end >= start and end <= _size)").drop("_none", "_size")


def decisions(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """id, decision (the gravest action), finding_count, categories (sorted) of every document; allow without findings."""
    grave = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    per = found.groupBy(id_col).agg(F.max(grave).alias("_g"), F.count("*").alias("finding_count"), F.sort_array(F.collect_set("category")).alias("categories"))
    out = docs.select(id_col).join(per, id_col, "left")
    decision = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.coalesce(F.col("_g"), F.lit(1)).cast("int"))
    return out.select(id_col, decision.alias("decision"), F.coalesce("finding_count", F.lit(0)).alias("finding_count"), F.coalesce("categories", F.expr("cast(array() as array<string>)")).alias("categories"))


def finding_counts(found: DataFrame, id_col: str) -> DataFrame:
    """id, category_counts and detector_counts: maps in order of their keys, of the documents that have findings."""

    def counted(column: str, name: str) -> DataFrame:
        each = found.groupBy(id_col, column).agg(F.count("*").alias("n"))
        return each.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    return counted("category", "category_counts").join(counted("detector", "detector_counts"), id_col)


def scan(docs: DataFrame, policy: Policy = Policy(), id_col: str = "document_id") -> DataFrame:
    """``docs`` after the scan: content, title, author, metadata and source_metadata with what is to be redacted replaced, content_hash renewed where the content changed.

    Besides: decision, finding_count, category_counts, detector_counts, redacted,
    and in ``security`` (where the documents have it) sensitive_categories, the old
    ones and then the new, and contains_sensitive_data. Ids are unique. Columns
    that a policy doesn't scan stay as they are.
    """
    found = materialize(findings(document_fields(docs, id_col, policy), id_col, policy), "findings")
    decided = decisions(docs, found, id_col).join(finding_counts(found, id_col), id_col, "left")
    out = docs.join(decided, id_col)
    inside = policy.redacting()
    if inside:
        plain = ["content", *(["title"] if policy.title else []), *(["author"] if policy.author else [])]
        before = {c: F.col(c) for c in plain}
        out = out.withColumns({**{f"_old_{c}": v for c, v in before.items()}, **{c: redact(v, inside) for c, v in before.items()}})
        for column, prefix, on in (("metadata", "metadata", policy.metadata), ("source_metadata", "source.metadata", policy.source_metadata)):
            if on:
                leaves = nested_fields(docs, id_col, column, prefix)
                changed = leaves.withColumn("clean", redact(F.col("text"), inside)).where("clean <> text").select(id_col, "field_path", F.col("clean").alias("text"))
                out = put_fields(out, changed, id_col, column, prefix)
        other = F.lit(False)
        for c in plain:
            other = other | F.coalesce(F.col(c) != F.col(f"_old_{c}"), F.lit(False))
        spans = found.where("action = 'redact' and start is not null").select(F.col(id_col).alias("_id")).distinct().withColumn("_in", F.lit(True))
        out = out.join(spans, F.col(id_col) == F.col("_id"), "left").withColumn("redacted", other | F.coalesce("_in", F.lit(False)))
        out = out.withColumn("content_hash", F.when(F.coalesce(F.col("content") != F.col("_old_content"), F.lit(False)), F.sha2("content", 256)).otherwise(F.col("content_hash")) if "content_hash" in docs.columns else F.sha2("content", 256))
        out = out.drop("_id", "_in", *[f"_old_{c}" for c in plain])
    else:
        out = out.withColumn("redacted", F.lit(False))
    if "security" in docs.columns:
        new = F.when(F.col("decision") != "allow", F.col("categories")).otherwise(F.expr("cast(array() as array<string>)"))
        old = F.coalesce("security.sensitive_categories", F.expr("cast(array() as array<string>)"))
        changed = F.col("security").withField("sensitive_categories", F.array_distinct(F.concat(old, new))).withField("contains_sensitive_data", F.coalesce("security.contains_sensitive_data", F.lit(False)) | (F.size(new) > 0))
        out = out.withColumn("security", changed)
    return out.drop("categories")


def redact_spans(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, replacement) replaced: from the left, the longest of those that begin together, overlaps skipped."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(s.out, F.substring(text, s.at + 1, x.start - s.at), x.replacement)
        return F.when(x.start < s.at, s).otherwise(F.struct(kept.alias("out"), x.end.alias("at")))

    return F.aggregate(ordered, state, step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, F.length(text))))


def replacement(kind: Column, category: Column) -> Column:
    name = F.upper(F.substring_index(category, ":", -1))
    return F.when(kind == "pii", F.concat(F.lit("[PII:"), name, F.lit("]"))).when(name.isin("INTERNAL_IP", "LOCAL_PATH"), F.concat(F.lit("["), name, F.lit("]"))).otherwise("[REDACTED]")


def redact(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """``text`` with what the detectors find replaced, in one expression and without a join."""
    def marked(d: Detector) -> Column:
        return F.transform(matches(text, d), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), replacement(F.lit(d.kind), F.lit(f"{d.kind}:{d.name}")).alias("replacement")))

    spans = F.concat(*[marked(d) for d in detectors if d.span])
    return F.when(text.isNotNull(), F.coalesce(redact_spans(text, spans), text))
