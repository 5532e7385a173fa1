"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source gives the documents whose hash lies
below its threshold once more than the others; the threshold is where the tokens
below it come nearest to the source's budget. It is found by histograms of
tokens by source and hash bucket: the bucket that the budget ends in is cut into
finer buckets, again and again, until it holds one document or documents of one
hash. No sort, and the driver sees one small histogram a step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.scratch import materialize

_STEP = 12  # bits of the hash that one histogram tells apart
_BITS = 60


@dataclass(frozen=True)
class MixConfig:
    """``total_tokens``: size of the mixture; None takes the greatest at which no source needs more than its cap.
    ``seed``: of the hashes. ``max_sources``: bound on the rows of the targets, which the driver holds."""

    total_tokens: int | None = None
    seed: int = 7
    max_sources: int = 10_000


@dataclass
class Plan:
    source: str
    target: float
    cap: int
    size: int
    docs: int
    full: int = 0  # uses of every document
    rest: float = 0.0  # tokens wanted beyond them
    low: int = 0  # documents of a lower hash are used once more
    below: int = 0  # tokens of those
    bits: int = 0  # leading bits of the hash that are settled
    open: bool = False


def source_key(source: Column) -> Column:
    """Sources are compared without case and surrounding white space."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def plan_budgets(plans: list[Plan], total: int | None) -> float:
    """Fill in uses and remainders; returns the size of the mixture in tokens."""
    there = [p for p in plans if p.size > 0 and p.cap > 0 and p.target > 0]
    weight = sum(p.target for p in there)
    if not there:
        return 0.0
    reach = min(p.cap * p.size * weight / p.target for p in there)
    mixture = reach if total is None else float(total)
    for p in there:
        budget = min(p.target / weight * mixture, p.cap * p.size)
        p.full = min(int(budget / p.size + 1e-9), p.cap)
        p.rest = max(0.0, budget - p.full * p.size)
        p.open = p.full < p.cap and p.rest > 1e-6
    return mixture


def settle(plan: Plan, histogram: list[tuple[int, int, int]]) -> None:
    """Go down into the bucket that the budget ends in. ``histogram``: bucket, tokens, documents, in order, of the bucket settled so far."""
    width, base = _BITS - plan.bits - _STEP, plan.low
    for bucket, tokens, docs in histogram:
        start = base + (bucket << width)
        if plan.below + tokens <= plan.rest:
            plan.below += tokens
            plan.low = start + (1 << width)
            continue
        if docs == 1 or width <= 0:  # one document, or all of one hash: in or out, whichever is nearer
            if plan.below + tokens - plan.rest < plan.rest - plan.below:
                plan.below += tokens
                start += 1 << width
            plan.low, plan.open = start, False
            return
        plan.low, plan.bits = start, plan.bits + _STEP
        return
    plan.open = False  # the budget reaches the end of what is left


def mix(docs: DataFrame, targets: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, DataFrame]:
    """The selection and its report.

    ``docs``: doc_id, source, n_tokens. ``targets``: source, target_share,
    max_repeats. The selection has doc_id, source (its key), n_tokens, copies
    (1 to max_repeats), target_share and actual_share; the report one row a
    target: source, target_share, actual_share, tokens, documents,
    available_tokens, max_repeats.

    Sources are compared by :func:`source_key`; documents of null, blank and
    unlisted sources, and documents without tokens, take no part. Of a target
    given twice the shares add up and the greater cap holds; null and negative
    values count 0. A source that is absent leaves its share to the others in
    proportion, which no selection can better. Documents of equal hash are used
    alike or, at the threshold, all or none. Repeated ids are documents of their
    own. Empty tables give an empty selection.
    """
    given = targets.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("target"),
        F.max(F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0))).alias("cap"),
    )
    listed = given.where("source is not null and source <> ''").limit(config.max_sources + 1).collect()
    if len(listed) > config.max_sources:
        raise ValueError(f"more than {config.max_sources} target sources")
    spark = docs.sparkSession
    names = [r.source for r in listed]
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(config.seed)), 64 - _BITS)
    sized = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"), hashed.alias("h"))
    sized = materialize(sized.where((F.col("n_tokens") > 0) & F.col("source").isin(names)), "sizes")
    sums = {r.source: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs")).collect()}
    plans = [Plan(r.source, r.target, r.cap, sums[r.source].size if r.source in sums else 0, sums[r.source].docs if r.source in sums else 0) for r in listed]
    plan_budgets(plans, config.total_tokens)
    while todo := [p for p in plans if p.open]:
        # The open buckets as a table, max_sources rows at most: of each source how many bits are settled, and which they are.
        settled = spark.createDataFrame([(p.source, _BITS - p.bits, p.low >> (_BITS - p.bits)) for p in todo], "source string, beyond int, prefix long")
        inside = sized.join(F.broadcast(settled), "source").where(F.expr("shiftright(h, beyond) = prefix"))
        number = F.expr(f"shiftright(h, beyond - {_STEP}) & {(1 << _STEP) - 1}")
        sums = inside.groupBy("source", number.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        # Only the first bucket that goes beyond the budget matters, and what lies before it.
        so_far = Window.partitionBy("source").orderBy("bucket")
        left = spark.createDataFrame([(p.source, float(p.rest - p.below)) for p in todo], "source string, left double")
        reached = sums.withColumn("through", F.sum("tokens").over(so_far)).join(F.broadcast(left), "source")
        over = F.min(F.when(F.col("through") > F.col("left"), F.col("bucket")))
        ends = reached.groupBy("source").agg(over.alias("end"))
        rows = reached.join(F.broadcast(ends), "source").where("end is null or bucket <= end").groupBy("source", (F.col("bucket") == F.col("end")).alias("last")).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.max("bucket").alias("bucket")).collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r.source, []).append((r.bucket, r.tokens, r.docs))
        for p in todo:
            settle(p, sorted(by.get(p.source, [])))
    used = {p.source: p.full * p.size + (p.below if p.full < p.cap else 0) for p in plans}
    all_used = sum(used.values())
    shares = {s: used[s] / all_used if all_used else 0.0 for s in used}
    thresholds = spark.createDataFrame(
        [(p.source, p.full, p.cap, p.low if p.rest > 0 else 0, p.target, shares[p.source]) for p in plans], "source string, full int, cap int, low long, target_share double, actual_share double"
    )
    copies = F.col("full") + F.when((F.col("h") < F.col("low")) & (F.col("full") < F.col("cap")), 1).otherwise(0)
    selection = sized.join(F.broadcast(thresholds), "source").withColumn("copies", copies).where("copies > 0")
    selection = selection.select("doc_id", "source", "n_tokens", "copies", "target_share", "actual_share")
    chosen = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"))
    schema = T.StructType.fromDDL("source string, target_share double, actual_share double, available_tokens long, max_repeats int")
    report = spark.createDataFrame([(p.source, p.target, shares[p.source], p.size, p.cap) for p in plans], schema).join(chosen, "source", "left")
    return selection, report.na.fill(0, ["tokens", "documents"])
