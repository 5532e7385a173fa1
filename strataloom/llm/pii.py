"""Personal information in free text by a linear-chain conditional random field.

The field reads words and the shapes of what surrounds them and tags e-mail addresses,
phone numbers, identity numbers, street addresses and persons' names: types and spans
are what Viterbi decodes, and nothing is matched by a pattern. It is trained from a small
labelled table (``pii_samples``). Each task cuts its texts into words, looks up the scores
of each different word once, and runs Viterbi over batches of runs of words: words further
than ``REACH`` from any where a tag could win need no Viterbi and separate two runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.crf import OFFSETS, Crf, decode_runs, train
from strataloom.llm.pii_samples import labelled_lines, safe_carrier

ENTITIES = ("email", "phone", "identity_number", "street_address", "person_name")
LABELS = ["O", *[f"{p}-{e}" for e in ENTITIES for p in "BI"]]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

# A chunk ends at white space, which belongs to it, and at = : ; | < > and a double quote; a Han character is a chunk of its own.
_CHUNK = re.compile(r"[\u3400-\u9fff]\s*|[^\s\u3400-\u9fff=:;|<>\"]+[=:;|<>\"]?\s*|[=:;|<>\"]\s*|\s+")
# A word is a run of letters or digits or another character of a chunk, with the white space after it.
_WORD = re.compile(r"(?:[^\W\d_]+|\d+|[^\w\s]|_)\s*|\s+")
_EDGE = re.compile(r"[\W_]*")

REACH = 4

# Variants of one character each: full-width forms, odd spaces and hyphens are read as the plain ones, and offsets stay.
_PLAIN = {0xFF01 + i: 0x21 + i for i in range(94)} | dict.fromkeys([0xA0, 0x2007, 0x2009, 0x202F, 0x3000], 0x20) | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2212], 0x2D)

@dataclass(frozen=True)
class PiiConfig:
    """``lines``: rows of the labelled table; ``carriers``: lines of the corpus that it is put together with at most, from a sample of about ``items``
    items. ``caution``: how much the score of no tag is lowered before decoding. ``words``: different words a task remembers.
    ``most_names``: of the lexicon, which the driver holds; more are an error."""

    lines: int = 7000
    carriers: int = 3000
    items: int = 4000
    epochs: int = 8
    batch: int = 128
    l2: float = 1e-5
    rate: float = 0.05
    caution: float = 0.0
    words: int = 200_000
    most_names: int = 100_000
    seed: int = 5


@dataclass(frozen=True)
class Lexicon:
    """Known names, and the beginnings and ends that several of them share."""

    given: frozenset[str]
    family: frozenset[str]
    given_heads: frozenset[str]
    given_tails: frozenset[str]
    family_heads: frozenset[str]
    family_tails: frozenset[str]

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Lexicon:
        kinds = {k: frozenset(n.lower().strip() for n, kind in rows if n and n.strip() and kind == k) for k in ("given", "family")}

        def parts(names: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
            heads: dict[str, set[str]] = {}
            tails: dict[str, set[str]] = {}
            for n in names:
                for i in range(2, len(n) - 1):
                    heads.setdefault(n[:i], set()).add(n[i:])
                    tails.setdefault(n[i:], set()).add(n[:i])
            return frozenset(h for h, x in heads.items() if len(x) > 2), frozenset(t for t, x in tails.items() if len(x) > 2)

        return Lexicon(kinds["given"], kinds["family"], *parts(kinds["given"]), *parts(kinds["family"]))

    def like(self, word: str, kind: str) -> bool:
        """Known, or put together of a shared beginning and a shared end; of a double name both parts."""
        names, heads, tails = (self.given, self.given_heads, self.given_tails) if kind == "given" else (self.family, self.family_heads, self.family_tails)
        return all(p in names or any(p[:i] in heads and p[i:] in tails for i in range(2, len(p) - 1)) for p in word.lower().split("-"))


def _case(word: str) -> str:
    if word.isupper():
        return "U"
    if word.islower():
        return "l"
    return "C" if word[:1].isupper() and word[1:].islower() else "m"


def _shape(text: str, runs: bool) -> str:
    """Letters as A and a, digits as d, all else as it is; ``runs``: each run of letters, and of digits, as one."""
    if runs:
        return re.sub(r"\d+", "d", re.sub(r"[^\W\d_]+", "a", text))
    return re.sub(r"\d", "d", re.sub(r"[^\W\d_]+", lambda m: "a" if len(m[0]) > 2 else "A" * len(m[0]), text))


def words_in(chunk: str) -> list[tuple[str, tuple[str, ...]]]:
    """Words of a chunk, each with what the chunk says of it: shapes of the chunk without its edges, and the word's place in it."""
    words = _WORD.findall(chunk)
    if len(words) == 1:
        return [(words[0], ())]
    body = chunk.rstrip().translate(_PLAIN)
    head, foot = _EDGE.match(body).end(), 0
    while foot < len(body) - head and not body[len(body) - foot - 1].isalnum():
        foot += 1
    core = body[head : len(body) - foot]
    fine, coarse = _shape(core, False)[:24], _shape(core, True)[:16]
    local, at, domain = core.partition("@")
    mail = f"mail={bool(local)}{_shape(domain, True)[-12:]}" if at else ""
    out, where = [], 0
    for w in words:
        if where < head:
            said: tuple[str, ...] = ("edge=<",)
        elif where >= len(body) - foot:
            said = ("edge=>",)
        else:
            place = "first" if where == head else "last" if where + len(w.rstrip()) >= len(body) - foot else "mid"
            side = "" if not at else "<" if where - head <= len(local) else ">"
            said = (f"fine={fine}", f"coarse={coarse}", f"place={place}{side}", *([mail, f"{mail}{place}{side}"] if mail else [f"fine={fine}{place}"]))
        out.append((w, said))
        where += len(w)
    return out


def features_of(word: str, said: tuple[str, ...], lexicon: Lexicon) -> list[str]:
    """Features of one word with its white space: spelling, shape, ends, what the lexicon has of it, and what its chunk says of it."""
    body = word.rstrip().translate(_PLAIN)
    gap = "n" if "\n" in word else "s" if len(body) < len(word) else "-"
    low = body.lower()
    out = [f"gap={gap}", "bias", *said]
    if body.isdigit():
        size = min(len(body), 14)
        return [*out, f"num={size}", f"num={size}{gap}", f"zero={body[:2] == '00'}{body[:1] == '0'}", f"num={size}{'' if said else 'alone'}", *([f"w={body}"] if len(body) <= 2 else [])]
    out += [f"w={low}", f"w={low}{gap}"]
    if "\u3400" <= body <= "\u9fff":
        out.append("han")
    elif body.isalpha():
        out += [f"case={_case(body)}{gap}", f"len={min(len(body), 9)}", f"p3={low[:3]}", f"s3={low[-3:]}", f"s4={low[-4:]}"]
        for kind in ("given", "family"):
            if len(body) > 3 and lexicon.like(body, kind):
                out += [f"like={kind}", f"like={kind}{_case(body)}{gap}"]
    return out


def words_of(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], np.ndarray]:
    """Words that together are the text, each with what its chunk says of it, and where each begins."""
    words = [w for c in _CHUNK.findall(text) for w in words_in(c)]
    return words, np.concatenate([[0], np.cumsum([len(w) for w, _ in words])]).astype(np.int64)


def fit(labelled: pd.DataFrame, lexicon: Lexicon, config: PiiConfig) -> Crf:
    """Train from rows (text, spans: (start, end, entity) of it)."""
    numbers: dict[tuple, int] = {("", ()): 0}
    word_features: list[list[int]] = [[]]
    features: dict[str, int] = {}
    sequences, tags = [], []
    for text, spans in labelled[["text", "spans"]].itertuples(index=False):
        words, at = words_of(text)
        tag = np.zeros(len(words), np.int64)
        for s, e, kind in spans:
            inside = np.flatnonzero((at[:-1] < e) & (at[1:] > s))
            for k, i in enumerate(inside):
                tag[i] = 1 + 2 * ENTITIES.index(kind) + (k > 0)
        ids = []
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
                word_features.append([features.setdefault(f, len(features)) for f in features_of(*w, lexicon)])
            ids.append(numbers[w])
        for a in range(0, len(ids), 60):  # long lines in pieces
            sequences.append(ids[a : a + 60])
            tags.append(tag[a : a + 60].tolist())
    pairs = [(s, t) for s, t in zip(sequences, tags) if s]
    if not pairs:
        L = len(LABELS)
        return Crf(LABELS, {}, np.zeros((len(OFFSETS), 1, L), np.float32), np.zeros((L, L), np.float32), np.zeros(L, np.float32), np.zeros(L, np.float32))
    return train([p[0] for p in pairs], [p[1] for p in pairs], word_features, len(features), LABELS, features, config.epochs, config.l2, config.rate, config.seed, config.batch)


class Tagger:
    """A trained field in a task: scores of each different word are worked out once."""

    def __init__(self, crf: Crf, lexicon: Lexicon, config: PiiConfig):
        self.crf, self.lexicon, self.config = crf, lexicon, config
        self.reset()
        legal = np.ones_like(crf.trans, bool)
        for i, to in enumerate(LABELS):
            if to.startswith("I-"):
                legal[:, i] = [x[2:] == to[2:] for x in LABELS]
        self.trans = np.where(legal, crf.trans, -1e4).astype(np.float32)
        # What a path can gain by leaving O around one word: two transitions at most.
        free = max(float(crf.trans.max()), float(crf.start.max() - crf.start[0]) + float(crf.trans[0, 0]), float(crf.end.max() - crf.end[0]) + float(crf.trans[0, 0]))
        self.slack = 2 * max(0.0, free - float(crf.trans[0, 0]))

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {("", ()): 0}
        self.chunks: dict[str, tuple[list[int], list[int]]] = {}
        self.scores = np.zeros((len(OFFSETS), 1024, len(LABELS)), np.float32)

    def number(self, word: tuple[str, tuple[str, ...]]) -> int:
        n = self.numbers.get(word)
        if n is None:
            n = self.numbers[word] = len(self.numbers)
            if n >= self.scores.shape[1]:
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)], axis=1)
            known = [f for x in features_of(*word, self.lexicon) if (f := self.crf.features.get(x)) is not None]
            self.scores[:, n] = self.crf.weights[:, known].sum(axis=1)
        return n

    def chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        words = words_in(chunk)
        known = self.chunks[chunk] = [self.number(w) for w in words], [len(w) for w, _ in words]
        return known

    def tags(self, texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
        """Tagged spans (code points) of each text."""
        if len(self.chunks) > self.config.words:
            self.reset()
        ids: list[int] = []
        sizes: list[int] = []
        counts = []
        get, new = self.chunks.get, self.chunk
        for text in texts:
            before = len(ids)
            for c in _CHUNK.findall(text):
                n, size = get(c) or new(c)
                ids += n
                sizes += size
            counts.append(len(ids) - before)
        x = np.array(ids, np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        unary = np.zeros((len(x), len(LABELS)), np.float32)
        for k, o in enumerate(OFFSETS):
            if o == 0:
                unary += self.scores[k][x]
            elif len(x) > abs(o):
                a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
                unary[a] += self.scores[k][np.where(doc[a] == doc[b], x[b], 0)]
        unary[:, 0] -= self.config.caution
        maybe = unary[:, 0] - unary[:, 1:].max(axis=1) <= self.slack
        near = maybe.copy()
        for k in range(1, REACH + 1):  # a mention can have words inside that look like none
            near[k:] |= maybe[:-k]
            near[:-k] |= maybe[k:]
        active = np.flatnonzero(near)
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if len(active):
            cut = np.flatnonzero((np.diff(active) > 1) | (doc[active[1:]] != doc[active[:-1]])) + 1
            starts, ends = active[np.concatenate([[0], cut])], active[np.concatenate([cut - 1, [len(active) - 1]])] + 1
            first = np.where((starts == bounds[doc[starts]])[:, None], self.crf.start, self.trans[0])
            last = np.where((ends == bounds[doc[starts] + 1])[:, None], self.crf.end, self.trans[:, 0])
            first[:, [i for i, name in enumerate(LABELS) if name.startswith("I-")]] = -1e4
            for s, path in zip(starts, decode_runs(unary, starts, ends, self.trans, first, last)):
                i = 0
                while i < len(path):
                    if path[i] == 0:
                        i += 1
                        continue
                    kind, j = LABELS[path[i]][2:], i + 1
                    while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                        j += 1
                    d = doc[s]
                    found[d].append((int(begin[s + i] - begin[bounds[d]]), int(begin[s + j] - begin[bounds[d]]), kind))
                    i = j
        yield from found


def trimmed(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without the white space after their last word."""
    return [(s, s + len(text[s:e].rstrip()), kind) for s, e, kind in spans]


def lexicon_of(names: DataFrame, config: PiiConfig = PiiConfig()) -> Lexicon:
    """The lexicon of a table (name, kind: given or family). It is held whole by driver and tasks, so its size is checked."""
    rows = [(r["name"], r["kind"]) for r in names.select("name", "kind").limit(config.most_names + 1).collect()]
    if len(rows) > config.most_names:
        raise ValueError(f"the lexicon has more than most_names = {config.most_names} rows")
    return Lexicon.of(rows)


def label_table(items: DataFrame, lexicon: Lexicon, config: PiiConfig) -> pd.DataFrame:
    """The small labelled table (text, spans), in the company of at most ``carriers`` lines of ``items`` (item_id, text) that can hold no mention."""
    known = lexicon.given | lexicon.family
    buckets = 1_000_003
    share = min(1.0, config.items / max(items.count(), 1))
    picked = items.where(F.pmod(F.xxhash64("item_id", F.lit(config.seed)), F.lit(buckets)) < int(share * buckets) + 1)
    lines = picked.select(F.explode(F.split("text", r"[\r\n]+")).alias("line")).where("length(line) between 3 and 2000").distinct()
    some = [r.line for r in lines.orderBy(F.xxhash64("line", F.lit(config.seed))).limit(3 * config.carriers).collect()]
    carriers = [x for x in some if safe_carrier(x, known)][: config.carriers]
    return pd.DataFrame(labelled_lines(carriers, list(lexicon.given), list(lexicon.family), config.lines, config.seed), columns=["text", "spans"])


def find(items: DataFrame, crf: Crf, lexicon: Lexicon, config: PiiConfig = PiiConfig()) -> DataFrame:
    """Every row of ``items`` (item_kind, item_id, text) with mentions: array<struct<entity, span_start, span_end, value>> in order.

    Offsets are code points, the end exclusive. Null and empty texts have none.
    Repeated rows come out repeatedly; other columns are ignored; texts of any
    length are read whole. Mentions don't overlap.
    """
    shared = items.sparkSession.sparkContext.broadcast((crf, lexicon))  # the size of the labelled table's features

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(*shared.value, config)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            found: list[list] = []
            at, size = 0, 0
            for i, t in enumerate(texts):  # some millions of characters at a time
                size += len(t)
                if size > 2_000_000 or i == len(texts) - 1:
                    part = texts[at : i + 1]
                    found += [trimmed(t, spans) for t, spans in zip(part, tagger.tags(part))]
                    at, size = i + 1, 0
            out = batch[["item_kind", "item_id", "text"]].copy()
            out["mentions"] = [[{"entity": k, "span_start": a, "span_end": b, "value": t[a:b]} for a, b, k in f] for t, f in zip(texts, found)]
            yield out

    return items.select("item_kind", "item_id", "text").mapInPandas(tag, "item_kind string, item_id string, text string, mentions array<struct<entity: string, span_start: long, span_end: long, value: string>>")


def redact(text: str | None, mentions: list) -> str | None:
    if text is None or mentions is None or not len(mentions):
        return text
    out, at = [], 0
    for m in mentions:
        out += [text[at : m["span_start"]], PLACEHOLDERS[m["entity"]]]
        at = m["span_end"]
    return "".join([*out, text[at:]])


def redacted(found: DataFrame) -> DataFrame:
    """item_kind, item_id, redacted_text: each mention replaced by the placeholder of its type."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["item_kind", "item_id"]].assign(redacted_text=[redact(t, m) for t, m in zip(b["text"], b["mentions"])])

    return found.mapInPandas(apply, "item_kind string, item_id string, redacted_text string")
