"""Text quality statistics and the robust distance from a language's prose.

All statistics are built-in expressions over whole texts. For each language the
mean and covariance of prose are fitted over all documents of the corpus: the
first estimate is the median and the median absolute deviation, then documents
that lie too far off are left out and mean and covariance taken again, a fixed
number of times. A document's squared Mahalanobis distance is the sum of its
statistics' contributions, which are returned beside it. The distance from which
a document is no prose is calibrated on hand labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.scratch import materialize

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the a an and or of in on at to for from with by as is are was be it its that this these those every each our we they not but so before after while since until unless although because whenever why which when then than has have had one".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht in im an am auf aus bei mit nach von vor zu zum zur für ist sind war wird werden hat haben sich er sie es ihn dass wenn weil während bevor nachdem obwohl sobald jeder jede jedes unser als".split(),
    "fr": "le la les un une des du de et ou mais pas ne en dans sur au aux pour par avec sans est sont a ont il elle que qui ce cette ces chaque notre se si dès lorsque quand puisque tandis afin avant après".split(),
    "es": "el la los las un una unos unas y o pero no en de del al para por con sin es son está tiene tienen que se su sus este esta cada nuestro lo le si cuando porque aunque mientras hasta desde antes después".split(),
}
_CJK_COMMON = "了在与和会被把这每都个是不但而当就将并从对其"

_BULLET = r"^\s*(?:[-*+•‣◦·▪–]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)])\s+\S"
# A class at the head of a pattern lets the engine skip most characters; look-behinds come last. A wide class is
# behind a narrow one (&&), which turns most characters away first.
_SEPARATOR = r"(?=[\t│|;,]|   )(?:\t|│|\|(?<!\S\|)|[;,](?=\S|$)|[ \u3000]{3,}(?=\S))"
_RULE = r"^[┌└├─┼┬┴┐┘┤=|:+\-\s]{5,}$"
_ENDS = list(".!?。！？…:：;；\"”»)）")
_MACHINE = r"(?=[=.:\"{])(?:=\S(?<=\w=.)|\.\w{1,24}\(|:\d\d:\d\d|\"\s*:|\{\"|://)"
_SYMBOLS = r"#$%&*+/<=>@\[\\\]^_`{|}~\u00A1-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u00D7\u00F7\u2010-\u2027\u2030-\u206F\u20A0-\u2BFF\u3003-\u3007\u3010-\u3020\uFFF0-\uFFFF"
_IN_WORD = r"[?$%^~\\\u00A1-\u00A9\u00AB-\u00B3\u00B6\u00B8\u00B9\u00BC-\u00BF\u00D7\u00F7\u2190-\u24FF\u25A0-\u2BFF](?=[\p{L}?$%^~\\\u00A1-\u00A9\u00AB-\u00B3\u00B6\u00B8\u00B9\u00BC-\u00BF])(?<=\p{L}.)"
_BROKEN = r"[\uFFFD\u25A1]|[\u00C2-\u00F4][\u0080-\u00BF\u0152-\u0178\u017D\u017E\u0192\u02C6\u02DC\u2013-\u203A\u20AC\u2122]"
_SUSPECT = r"[\W&&\S&&[?\^~\\\u00A1-\u00A9\u00AB-\u00B3\u00B6\u00B8\u00B9\u00BC-\u00BF\u00C2-\u00F4\u2190-\u24FF\u25A0-\u2BFF\uFFFD]](?:(?<!\?)|(?<=\p{L}\?)(?=\p{L}))"
_ODD = _IN_WORD + "|" + _BROKEN

STATISTICS = ("word_length", "symbols", "digits", "common", "ended", "rows", "entries", "singles", "odd", "long_runs", "repeats", "machine")
# The least standard deviation that a statistic of prose is credited with.
FLOORS = (0.5, 0.02, 0.06, 0.05, 0.25, 0.08, 0.08, 0.04, 0.012, 0.02, 0.06, 0.02)


@dataclass(frozen=True)
class QualityConfig:
    """``keep``: squared distance up to which a document counts as prose while fitting. ``max_labels``: labelled documents used,
    the first by a hash of their ids. ``cutoff``: squared distance of a document that is no prose where there are no labels."""

    rounds: int = 3
    keep: float = 26.0
    max_labels: int = 20_000
    cutoff: float = 30.0
    mostly: float = 0.5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _cut(text: Column, pattern: str) -> Column:
    """Characters in the runs that match: one match a run costs less than one a character."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc, language, n_chars, n_words, n_lines, and the columns STATISTICS.

    Null and blank texts have zeros and the language ``none``. The language is
    that of the most function words, Chinese where a fifth of the characters is;
    without any the declared one stands, in lower case, or ``und``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.col(doc).alias(doc), t.alias("t"), F.lower(F.trim(F.col(lang))).alias("declared"))
    lines = F.filter(F.split("t", r"[\r\n]+"), lambda x: x.rlike(r"\S"))
    counts = base.select(
        doc, "t", "declared", lines.alias("lines"), F.length("t").alias("n_chars"), F.filter(F.split(F.lower("t"), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "").alias("words"),
        F.when(F.col("t").rlike(r"(?U)\S"), F.length("t")).otherwise(0).alias("solid"), _cut(F.col("t"), "[㐀-鿿]+").alias("cjk"),
    )
    def among(known: list[str]) -> Column:
        return F.size(F.filter("words", lambda w: w.isin(known)))

    lone = F.size(F.filter("words", lambda w: (F.octet_length(w) <= 2) & (F.length(w) == 1) & ~w.isin(list("ayoei0123456789"))))
    runs = F.aggregate(F.filter("words", lambda w: F.octet_length(w) >= 25), F.lit(0), lambda a, w: a + F.when(w.rlike("^[a-z0-9]+$"), F.length(w)).otherwise(0))
    numbers = F.size(F.filter("words", lambda w: (w >= "0") & (w < ":")))
    commons = [among(known).alias(f"c_{x}") for x, known in COMMON_WORDS.items()]
    counts = counts.select("*", *commons, F.when(F.col("cjk") > 0, F.length("t") - F.length(F.translate("t", _CJK_COMMON, ""))).otherwise(0).alias("c_zh"), (F.size("words") + F.col("cjk")).alias("n_words"), lone.alias("lone"), runs.alias("runs"), numbers.alias("numbers")).drop("words")
    best = F.greatest(*[F.col(f"c_{x}") for x in COMMON_WORDS])
    language = F.when(F.col("solid") == 0, "none").when(F.col("cjk") > 0.2 * F.col("solid"), "zh")
    for x in COMMON_WORDS:
        language = language.when((best > 0) & (F.col(f"c_{x}") == best), x)
    language = language.otherwise(F.when(F.col("declared").isin(*COMMON_WORDS, "zh"), F.col("declared")).otherwise("und"))
    counts = counts.withColumn("language", language)
    any_common = sorted({w for ws in COMMON_WORDS.values() for w in ws})

    def entry(x: Column) -> Column:
        """A few words without a function word or an end."""
        words = F.split(F.lower(x), r"[^\p{L}\p{M}]+")
        return F.when((F.length(x) > 60) | F.right(F.rtrim(x), F.lit(1)).isin(_ENDS), False).when(
            F.size(F.split(F.trim(x), r"\s+")) > 6, False
        ).otherwise(~F.exists(words, lambda w: w.isin(any_common)) & ~x.rlike(f"[{_CJK_COMMON}]"))

    def row(x: Column) -> Column:
        found = F.regexp_count(x, F.lit(_SEPARATOR))
        return ((found >= 2) & (found * 40 >= F.length(x))) | x.rlike(_RULE)

    marked = F.transform(
        "lines",
        lambda x: F.struct(F.length(x).alias("n"), row(x).alias("row"), x.rlike(_BULLET).alias("bullet"), F.right(F.rtrim(x), F.lit(1)).isin(_ENDS).alias("ended"), entry(x).alias("short")),
    )
    counts = counts.withColumn("marked", marked)
    share = lambda keep: F.aggregate(F.filter("marked", keep), F.lit(0), lambda a, x: a + x.n)
    rows, in_rows = F.size(F.filter("marked", lambda x: x.row & ~x.bullet)), share(lambda x: x.row & ~x.bullet)
    shorts, in_entries = F.size(F.filter("marked", lambda x: x.bullet | (x.short & ~x.row))), share(lambda x: x.bullet | (x.short & ~x.row))
    all_lines = F.aggregate("marked", F.lit(0), lambda a, x: a + x.n)
    sentences = F.filter(F.split("t", r"[.!?。！？\r\n]+"), lambda x: F.length(x) > 3)
    counts = counts.withColumn("sentences", sentences)
    solid, words = F.col("solid"), F.col("n_words")
    out = counts.select(
        doc, "language", "n_chars", "n_words", F.size("lines").alias("n_lines"),
        _ratio(solid, words).alias("word_length"),
        _ratio(_cut(F.col("t"), rf"[[\W_]&&\S&&[{_SYMBOLS}]]+"), solid).alias("symbols"),
        _ratio(F.col("numbers"), words).alias("digits"),
        _ratio(F.when(F.col("language") == "zh", 3 * F.col("c_zh")).otherwise(best), words).alias("common"),
        _ratio(F.size(F.filter("marked", lambda x: x.ended)), F.size("lines")).alias("ended"),
        F.when(rows >= 3, _ratio(in_rows, all_lines)).otherwise(0.0).alias("rows"),
        F.when(shorts >= 3, _ratio(in_entries, all_lines)).otherwise(0.0).alias("entries"),
        _ratio(F.col("lone"), words).alias("singles"),
        _ratio(F.when(F.col("t").rlike(_SUSPECT), _count(F.col("t"), _ODD)).otherwise(0), words).alias("odd"),
        _ratio(F.col("runs"), solid).alias("long_runs"),
        (1 - _ratio(F.size(F.array_distinct("sentences")), F.size("sentences"))).alias("r0"),
        _ratio(_count(F.col("t"), _MACHINE), words).alias("machine"), F.size("sentences").alias("n_sentences"),
    )
    out = out.withColumn("repeats", F.when(F.col("n_sentences") > 1, F.col("r0")).otherwise(0.0))
    return out.select(doc, "language", "n_chars", "n_words", "n_lines", *STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    precision: np.ndarray


def _diagonal(center: np.ndarray, spread: np.ndarray) -> Model:
    return Model(center, np.diag(1 / np.maximum(spread, FLOORS) ** 2))


def distances(x: np.ndarray, languages: np.ndarray, models: dict[str, Model]) -> np.ndarray:
    """Contributions of each statistic to each row's squared distance; a language without a model has that of all."""
    out = np.zeros_like(x)
    for language in np.unique(languages.astype(str)):
        at = languages.astype(str) == language
        m = models.get(language, models[""])
        d = x[at] - m.mean
        out[at] = d * (d @ m.precision)
    return out


def fit(stats: DataFrame, config: QualityConfig) -> dict[str, Model]:
    """Prose models by language, and of all languages under ''. The driver sees sums by language: a row for each of a few languages."""
    names, p = list(STATISTICS), len(STATISTICS)
    real = stats.where("language <> 'none'")
    with_all = real.withColumn("language", F.explode(F.array("language", F.lit(""))))
    medians = {r.language: np.array(r.m, float) for r in with_all.groupBy("language").agg(F.array(*[F.percentile_approx(c, 0.5, 1000) for c in names]).alias("m")).collect()}
    if not medians:
        return {"": _diagonal(np.zeros(p), np.ones(p))}
    medians.pop("und", None)  # no language of its own
    models = {k: _diagonal(m, np.array(FLOORS) * 2) for k, m in medians.items()}
    fitted = {""}
    for _ in range(config.rounds):
        keep, now = config.keep, models

        def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                x, lang = batch[names].to_numpy(float), batch["language"].to_numpy(object)
                good = distances(x, lang, now).sum(1) <= keep
                for key in {*lang[good], ""}:
                    part = x[good] if key == "" else x[good & (lang == key)]
                    both = np.hstack([np.ones((len(part), 1)), part])
                    sums[key] = sums.get(key, 0) + both.T @ both
            yield pd.DataFrame([(k, v.ravel().tolist()) for k, v in sums.items()], columns=["language", "sums"])

        parts = real.select("language", *names).mapInPandas(moments, "language string, sums array<double>")
        total = parts.groupBy("language").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range((p + 1) ** 2)]).alias("sums")).collect()
        for r in total:
            s = np.array(r.sums, float).reshape(p + 1, p + 1)
            if (n := s[0, 0]) < 5 * p or r.language not in models:
                continue
            fitted.add(r.language)
            mean = s[0, 1:] / n
            cov = s[1:, 1:] / n - np.outer(mean, mean) + np.diag(np.array(FLOORS) ** 2)
            models[r.language] = Model(mean, np.linalg.inv(cov))
    return {k: m for k, m in models.items() if k in fitted}


def score(stats: DataFrame, models: dict[str, Model], doc: str = "doc_id") -> DataFrame:
    """``stats`` with distance2 and the contributions of the statistics, a map."""
    names = list(STATISTICS)
    keep = [f.name for f in stats.schema.fields]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = distances(batch[names].to_numpy(float), batch["language"].to_numpy(object), models)
            yield batch.assign(distance2=c.sum(1), parts=list(c))

    scored = stats.mapInPandas(apply, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", distance2 double, parts array<double>")
    return scored.select(*keep, "distance2", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "parts").alias("contributions"))


def calibrate(pairs: list[tuple[float, bool]], config: QualityConfig) -> float:
    """The cutoff at which the labels prose and not prose are told apart best; ties: the middle of the range."""
    good = sorted(d for d, prose in pairs if prose)
    bad = sorted(d for d, prose in pairs if not prose)
    if len(good) < 10 or len(bad) < 10:
        return config.cutoff
    grid = np.quantile(np.array(good + bad), np.linspace(0.02, 0.98, 193))
    g, b = np.array(good), np.array(bad)
    right = np.array([(g < c).sum() + (b >= c).sum() for c in grid])
    best = grid[right == right.max()]
    return float(np.sqrt(best.min() * best.max()))


def kind_of(config: QualityConfig) -> Column:
    """table or list where most of the text is laid out so and isn't machine output; junk otherwise."""
    noise = (F.col("machine") > 0.12) | (F.col("odd") > 0.15) | (F.col("symbols") > 0.6) | (F.col("long_runs") > 0.2)
    return F.when(noise, "junk").when(F.col("rows") >= config.mostly, "table").when(F.col("entries") >= config.mostly, "list").otherwise("junk")


def assess(df: DataFrame, labels: DataFrame | None = None, doc: str = "doc_id", text: str = "text", lang: str = "lang", config: QualityConfig = QualityConfig()) -> DataFrame:
    """Every row's statistics, distance2, contributions and kind (prose, list, table, junk; null for null and blank texts).

    ``labels``: ``doc`` and label. Of a document labelled twice differently
    neither label counts, nor does a label of a document that isn't there.
    Repeated document ids give a row each. Other columns are ignored. An empty
    table gives an empty result; a language with fewer than five rows of prose a
    statistic is judged by the model of all languages.
    """
    stats = materialize(statistics(df, doc, text, lang), "stats")
    scored = score(stats, fit(stats, config), doc)
    cutoff = config.cutoff
    if labels is not None:
        one = labels.groupBy(doc).agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
        some = one.orderBy(F.xxhash64(doc)).limit(config.max_labels)
        known = scored.where("language <> 'none'").select(doc, "distance2").join(some, doc)
        cutoff = calibrate([(r.distance2, r.label == "prose") for r in known.select("distance2", "label").collect()], config)
    return scored.withColumn("kind", F.when(F.col("language") == "none", F.lit(None)).when(F.col("distance2") < cutoff, "prose").otherwise(kind_of(config)))
