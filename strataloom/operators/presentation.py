"""What a caller gets to see of ranked hits: attribution, and a prefix within a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import first_nonempty


@dataclass(frozen=True)
class Budget:
    max_results: int = 5
    max_chars: int = 10_000

    def __post_init__(self) -> None:
        if not 1 <= self.max_results <= 100 or not 2_048 <= self.max_chars <= 500_000:
            raise ValueError("max_results 1..100, max_chars 2048..500000")


def attribution(metadata: Column, row: dict[str, Column]) -> Column:
    """source struct of a hit: each field from the row, else from its metadata JSON (a title also from the document's, the file's or the conversation's name); section_path only if it has entries, numbers only where they are whole."""
    field = lambda name: F.get_json_object(metadata, f"$.{name}")
    none = F.lit(None).cast("string")
    path = F.from_json(field("section_path"), "array<string>")
    whole = lambda name: F.coalesce(row[name].cast("int") if name in row else F.lit(None).cast("int"), field(name).try_cast("int")).alias(name)
    return F.struct(
        first_nonempty(row.get("title", none), field("title"), field("document_title"), field("filename"), field("conversation_title")).alias("title"),
        *[first_nonempty(row.get(n, none), field(n)).alias(n) for n in ("document_id", "source_type", "provider", "source_id")],
        F.coalesce(whole("page_number"), field("page").try_cast("int"), field("page_no").try_cast("int")).alias("page_number"), whole("chunk_index"), whole("turn_start"), whole("turn_end"),
        F.when(F.size(path) > 0, path).alias("section_path"),
    )


def within_budget(hits: DataFrame, rank: str, body: Column, budget: Budget = Budget(), group: list[str] | None = None) -> DataFrame:
    """The longest prefix of hits whose compact JSON fits; the first comes always, flagged ``truncated`` if it alone is too long.

    Hits of a group are few (a top-k), so the window is small.
    """
    order = Window.partitionBy(*(group or [])).orderBy(rank) if group else Window.orderBy(rank)
    sized = hits.withColumn("chars", F.length(body)).withColumn("total_chars", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.col(rank) <= budget.max_results) & ((F.col("total_chars") <= budget.max_chars) | (F.col(rank) == 1))
    return sized.where(keep).withColumn("truncated", (F.col(rank) == 1) & (F.col("chars") > budget.max_chars))


def json_cost(text: Column) -> Column:
    """Characters that each character of ``text`` takes in JSON, as an array."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.length(F.to_json(F.struct(c.alias("c")))) - 8)


def cut_to(text: Column, room: Column) -> Column:
    """The longest beginning of ``text`` that takes at most ``room`` characters in JSON."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(True).alias("on"))

    def step(s: Column, cost: Column) -> Column:
        on = s.on & (s.used + cost <= room)
        return F.struct((s.n + on.cast("int")).alias("n"), F.when(on, s.used + cost).otherwise(s.used).alias("used"), on.alias("on"))

    return F.substring(text, F.lit(1), F.aggregate(json_cost(text), start, step, lambda s: s.n))


def presented(hits: DataFrame, rank: str, shown: list[str], budget: Budget = Budget(), group: list[str] | None = None) -> DataFrame:
    """What of each search's ``hits`` fits the budget, as JSON: group, rank, hit (its columns ``shown``, text among them, without nulls), text_truncated, total_hits, omitted, truncated.

    Whole hits come in order as long as the result, with its frame and its counts,
    has at most ``max_chars`` characters; only a first hit that alone is too long is
    cut, at a character. Hits of a group are few (a top-k). Ranks count from 1.
    """
    keys = group or []
    everything = Window.partitionBy(*(keys or [F.lit(1)]))
    so_far = everything.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda *more: F.to_json(F.struct(*shown, *more))
    flag = F.lit(True).alias("text_truncated")
    sized = hits.withColumn("total_hits", F.count(F.lit(1)).over(everything)).withColumn("_hit", hit())
    # The frame: {"results":[...],"total_hits":n,"omitted":n,"truncated":false}, counted with the longest numbers.
    frame = F.lit(len('{"results":[],"total_hits":,"omitted":,"truncated":false}')) + 2 * F.length(F.col("total_hits").cast("string"))
    sized = sized.withColumn("_chars", F.sum(F.length("_hit") + 1).over(so_far) - 1 + frame)
    long = (F.col(rank) == 1) & (F.col("_chars") > budget.max_chars)
    room = F.lit(budget.max_chars) - frame - F.length(F.to_json(F.struct(*[c for c in shown if c != "text"], F.lit("").alias("text"), flag)))
    kept = sized.where((F.col(rank) <= budget.max_results) & ((F.col("_chars") <= budget.max_chars) | long))
    kept = kept.withColumn("_cut", long).withColumn("text", F.when(long, cut_to(F.coalesce("text", F.lit("")), room)).otherwise(F.col("text")))
    # A hit that was cut fills the budget: none comes after it.
    kept = kept.withColumn("_first_cut", F.max("_cut").over(everything)).where(~F.col("_first_cut") | (F.col(rank) == 1))
    omitted = F.col("total_hits") - F.count(F.lit(1)).over(everything)
    out = kept.withColumn("omitted", omitted).withColumn("hit", F.when(F.col("_cut"), hit(flag)).otherwise(F.col("_hit")))
    return out.select(*keys, rank, "hit", F.col("_cut").alias("text_truncated"), "total_hits", "omitted", (F.col("_first_cut") | (F.col("omitted") > 0)).alias("truncated"))
