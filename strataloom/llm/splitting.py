"""Splitting oversized items at valleys of lexical cohesion.

Spark counts tokens, drops what fits, and cuts a text into units that are never
cut again: a sentence or a line, or a run of words where a line has no sentence
end in reach. Between neighbouring units lies a gap; the similarity of the words
before and after it has valleys where the topic changes. Each piece ends at the
deepest valley within the window of sizes that the limit leaves, among the gaps
of the best kind that the Markdown has there: never inside a fence or a table
while there is another. Units before a piece are repeated as overlap; where the
unit before is too long for that, its last words are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.tokens import TOKEN_RE, token_count

# A unit: at most 240 characters up to the end of a sentence or line with the white space after it; else up to
# the last white space; else up to the end of the identifier at hand. Blank lines belong to the unit before.
UNIT_RE = (
    r"[^\r\n]{1,240}?(?:[.!?](?=\s|\z)|[。！？；]|(?=[\r\n]|\z))[ \t]*[\r\n]*"
    r"|[^\r\n]{1,240}(?<=\s)"
    r"|[^\r\n]{1,240}[A-Za-z0-9_]*+(?:[-./:][A-Za-z0-9_]++)*+"
    r"|[\r\n]+"
)
_HEADING = re.compile(r"\s{0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*\s*$")
_FENCE = re.compile(r"\s{0,3}(```|~~~)")
_ROW = re.compile(r"\s*\||[^\n]*\t[^\n]*\t|[^\n]*\|[^\n]*\|")
_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]{4,}")
_TOKEN = re.compile(TOKEN_RE.removeprefix("(?U)"))  # white space of str patterns is Unicode's anyway


@dataclass(frozen=True)
class SplitConfig:
    """``min_fill``: share of the limit from which a cut is looked for. ``block_units``: units compared on each side of a gap.
    ``dims``: buckets that words are hashed into. The limit must leave room for a unit of 241 tokens beside the overlap."""

    max_tokens: int = 512
    overlap_tokens: int = 64
    min_fill: float = 0.5
    block_units: int = 4
    dims: int = 256

    def __post_init__(self) -> None:
        if not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("0 <= overlap_tokens < max_tokens")
        if self.max_tokens - self.overlap_tokens < 260:
            raise ValueError("max_tokens - overlap_tokens must be 260 at least: a unit has up to 241 tokens")


def structure(units: list[str]) -> tuple[np.ndarray, list[tuple[str, ...]], np.ndarray]:
    """Of each unit: how good a gap before it is (4 heading, 3 paragraph, 2 line, 1 sentence, 0 inside a sentence, fence or table), its section path, and whether it is a heading."""
    n = len(units)
    grade, paths, is_heading = np.zeros(n, np.int8), [], np.zeros(n, bool)
    stack: list[tuple[int, str]] = []
    path: tuple[str, ...] = ()
    fence, row_before, line_start, blank_before, ended = "", False, True, False, False
    for i, unit in enumerate(units):
        row = False
        if line_start:
            grade[i] = 3 if blank_before else 2
            mark = _FENCE.match(unit)
            if fence:
                grade[i] = 0
                if mark and mark[1] == fence:
                    fence = ""
            elif mark:
                fence = mark[1]
            elif head := _HEADING.match(unit):
                stack = [h for h in stack if h[0] < len(head[1])] + [(len(head[1]), head[2].strip())]
                path, grade[i], is_heading[i] = tuple(h[1] for h in stack), 4, True
            else:
                row = bool(_ROW.match(unit))
                if row and row_before:
                    grade[i] = 0
        else:
            grade[i] = 0 if fence else int(ended)
            row = row_before
        row_before = row
        paths.append(path)
        body = unit.rstrip()
        breaks = unit[len(body) :].count("\n") or unit[len(body) :].count("\r")
        line_start, blank_before = breaks > 0, breaks > 1
        ended = body[-1:] in ".!?。！？；"
        if i and is_heading[i - 1] and not is_heading[i]:
            grade[i] = 0  # a heading stays with what it heads
    return grade, paths, is_heading


def similarities(units: list[str], config: SplitConfig, memo: dict[str, int], block: int = 2048) -> np.ndarray:
    """Similarity of the words of the ``block_units`` units on either side of the gap before each unit. Counts are held of ``block`` units at a time."""
    n, k = len(units), config.block_units
    sim = np.zeros(n, np.float32)
    for at in range(0, n, block):
        low, high = max(0, at - k), min(n, at + block + k)
        places = []
        for i in range(low, high):
            for word in _WORD.findall(units[i].lower()):
                if (c := memo.get(word)) is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    c = memo[word] = zlib.crc32(word.encode()) % config.dims
                places.append((i - low) * config.dims + c)
        flat = np.bincount(np.array(places, np.int64), minlength=(high - low) * config.dims)
        sums = np.vstack([np.zeros(config.dims, np.float32), np.cumsum(flat.reshape(high - low, config.dims), axis=0, dtype=np.float32)])
        gap = np.arange(at, min(n, at + block)) - low
        left, right = sums[gap] - sums[np.maximum(gap - k, 0)], sums[np.minimum(gap + k, high - low)] - sums[gap]
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sim[gap + low] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)
    return sim


def valley_depths(units: list[str], config: SplitConfig, memo: dict[str, int]) -> np.ndarray:
    """Depth of the valley of block similarity at the gap before each unit."""
    n, k = len(units), config.block_units
    sim = similarities(units, config, memo)
    padded = np.pad(sim, k, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, k + 1)
    return windows[:n].max(1) + windows[k : k + n].max(1) - 2 * sim


def last_words(unit: str, most: int) -> tuple[str, int]:
    """The end of a unit from the first word on that leaves at most ``most`` tokens, and their number; of a longer run without white space its last tokens."""
    starts = [m.start() for m in _TOKEN.finditer(unit)][-most:] if most else []
    if not starts:
        return "", 0
    k = next((k for k, s in enumerate(starts) if s == 0 or unit[s - 1].isspace() or "㐀" <= unit[s] <= "鿿"), 0)
    return unit[starts[k] :], len(starts) - k


def cut(units: list[str], tokens: np.ndarray, config: SplitConfig, memo: dict[str, int]) -> Iterator[tuple[str, int, int, tuple[str, ...]]]:
    """Pieces as (overlap, first new unit, end, section path)."""
    n = len(units)
    total = np.concatenate([[0], np.cumsum(tokens)])
    grade, paths, is_heading = structure(units)
    depth = valley_depths(units, config, memo)
    start = 0
    while start < n:
        first = start
        while first > 0 and total[start] - total[first - 1] <= config.overlap_tokens:
            first -= 1
        overlap, repeated = "".join(units[first:start]), total[start] - total[first]
        if start and not repeated:  # whole units have more tokens, or none
            unit = int(np.searchsorted(total, total[start], side="left")) - 1  # the last one with a token
            if unit >= 0:
                words, repeated = last_words(units[unit], config.overlap_tokens)
                overlap = words + "".join(units[unit + 1 : start]) if repeated else overlap
        room = config.max_tokens - repeated
        end = int(np.searchsorted(total, total[start] + room, side="right")) - 1
        if end < n:
            end = best_gap(start, max(end, start + 1), total, grade, depth, config)
        content = next((i for i in range(start, end) if not is_heading[i] and units[i].strip()), start)
        yield overlap, start, end, paths[content]
        start = end


def best_gap(start: int, last: int, total: np.ndarray, grade: np.ndarray, depth: np.ndarray, config: SplitConfig) -> int:
    """The gap to cut at, in (start, last]: of the better grades the deepest valley; the later of equals."""
    for fill in (config.min_fill, 0.1):
        low = max(start + 1, int(np.searchsorted(total, total[start] + fill * config.max_tokens)))
        if low > last:
            continue
        gaps = np.arange(low, last + 1)
        for least in (2, 1) if fill == config.min_fill else (2,):
            good = gaps[grade[gaps] >= least]
            if len(good):
                score = depth[good] + 0.25 * grade[good]
                return int(good[len(good) - 1 - np.argmax(score[::-1])])
    gaps = np.arange(max(start + 1, (start + last) // 2), last + 1)
    return int(gaps[len(gaps) - 1 - np.argmax(depth[gaps][::-1])])


def join_paths(given: list[str] | None, inner: tuple[str, ...]) -> list[str]:
    base = [p.strip() for p in given if p and p.strip()] if given is not None else []
    if not inner:
        return base
    return (base[: base.index(inner[0])] if inner[0] in base else base) + list(inner)


_PIECES = "item_kind string, item_id string, piece_index int, text string, section_path array<string>, overlap_chars int"


def cut_batches(batches: Iterator[pd.DataFrame], config: SplitConfig) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for batch in batches:
        out = []
        for kind, item, units, tokens, given in batch.itertuples(index=False):
            units = list(units)
            given = None if given is None else list(given)
            for k, (overlap, start, end, path) in enumerate(cut(units, np.asarray(tokens, np.int64), config, memo)):
                out.append((kind, item, k, overlap + "".join(units[start:end]), join_paths(given, path), len(overlap)))
        yield pd.DataFrame(out, columns=["item_kind", "item_id", "piece_index", "text", "section_path", "overlap_chars"])


def oversized(items: DataFrame, config: SplitConfig) -> DataFrame:
    return items.where(token_count(F.col("text")) > config.max_tokens)


def split_oversized(items: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Pieces of every item above the limit: item_kind, item_id, piece_index, text, section_path, token_count, overlap_chars.

    ``items`` has item_kind, item_id, text and section_path; other columns are
    ignored. Items at or below the limit, and null, empty and blank texts, give
    no piece. Pieces follow the text and, without their overlap (the first
    ``overlap_chars`` code points), make it up again character by character.
    Each but the first has an overlap, of up to ``overlap_tokens`` tokens, if any token lies before it.
    ``token_count`` is the true approximate count and never above the limit.
    Repeated rows give repeated pieces. Texts of any length are cut whole.
    """
    units = F.regexp_extract_all("text", F.lit(UNIT_RE), F.lit(0))
    prepared = oversized(items, config).select("item_kind", "item_id", units.alias("units"), "section_path")
    prepared = prepared.select("item_kind", "item_id", "units", F.transform("units", lambda u: token_count(u).cast("int")).alias("tokens"), "section_path")
    pieces = prepared.mapInPandas(lambda batches: cut_batches(batches, config), _PIECES)
    return pieces.withColumn("token_count", token_count(F.col("text")))
