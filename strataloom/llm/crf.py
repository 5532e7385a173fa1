"""A linear-chain conditional random field in numpy: training by its gradient, and Viterbi over batches of runs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OFFSETS = (-2, -1, 0, 1, 2)


@dataclass
class Crf:
    """``weights``: for each offset of a neighbour, features x labels; ``trans``: label to label; ``start``, ``end``."""

    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _window(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word at each offset of each position, 0 (no word) beyond the ends. words: sequences x time, padded with 0."""
    n, t = words.shape
    out = np.zeros((len(OFFSETS), n, t), np.int64)
    for k, o in enumerate(OFFSETS):
        if abs(o) < t:
            out[k, :, max(0, -o) : t - max(0, o)] = words[:, max(0, o) : t + min(0, o)]
    return out


def train(
    sequences: list[list[int]], tags: list[list[int]], word_features: list[list[int]], n_features: int, labels: list[str], features: dict[str, int],
    epochs: int, l2: float, rate: float, seed: int, size: int = 128,
) -> Crf:
    """Minibatch Adam on the log-likelihood; a step changes the features of its batch only. ``word_features[w]``: the features of word w; word 0 is none.

    Forward and backward sums are scaled at each position, so they stay products of matrices.
    """
    rng = np.random.default_rng(seed)
    L, K = len(labels), len(OFFSETS)
    lengths = np.array([len(f) for f in word_features])
    flat = np.concatenate([np.asarray(f, np.int64) for f in word_features])
    begins = np.cumsum(lengths) - lengths
    by_length = np.argsort([len(s) for s in sequences], kind="stable")

    def prepared(batch: np.ndarray) -> dict:
        """All of a batch that doesn't change: words, tags, and how sums by position become sums by word and by feature."""
        n, lens = len(batch), np.array([len(sequences[i]) for i in batch])
        t = int(lens.max())
        x, y = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64)
        for i, j in enumerate(batch):
            x[i, : lens[i]], y[i, : lens[i]] = sequences[j], tags[j]
        win = _window(x, lens)
        used, inverse = np.unique(win, return_inverse=True)
        inverse = inverse.reshape(K, n * t)
        count = lengths[used]
        feats = flat[np.repeat(begins[used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        there = np.flatnonzero(count)
        order = np.argsort(feats, kind="stable")
        rows, firsts = np.unique(feats[order], return_index=True)
        places = [np.argsort(inverse[k], kind="stable") for k in range(K)]
        heads = [np.unique(inverse[k][places[k]], return_index=True) for k in range(K)]
        return {
            "n": n, "t": t, "lens": lens, "y": y, "mask": np.arange(t) < lens[:, None], "inverse": inverse, "words": len(used), "there": there, "starts": (np.cumsum(count) - count)[there],
            "at": np.searchsorted(rows, feats), "owner": np.repeat(np.arange(len(used)), count)[order], "rows": rows, "firsts": firsts, "places": places, "heads": heads,
        }

    batches = [prepared(by_length[i : i + size]) for i in range(0, len(by_length), size)]
    w = np.zeros((n_features, K, L), np.float32)
    small = {"t": np.zeros((L, L), np.float32), "s": np.zeros(L, np.float32), "e": np.zeros(L, np.float32)}
    m, v = ({"w": np.zeros_like(w), **{k: np.zeros_like(p) for k, p in small.items()}} for _ in range(2))
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in (batches[i] for i in rng.permutation(len(batches))):
            n, t, lens, y, mask = b["n"], b["t"], b["lens"], b["y"], b["mask"]
            mine = w[b["rows"]]
            sums = np.zeros((b["words"], K, L), np.float32)
            sums[b["there"]] = np.add.reduceat(mine[b["at"]], b["starts"], axis=0)
            unary = sum(sums[b["inverse"][k], k] for k in range(K)).reshape(n, t, L)
            u = np.exp(unary - unary.max(axis=2, keepdims=True))
            trans, first, last = (np.exp(small[k]) for k in "tse")
            alpha, beta, scale = np.zeros((n, t, L)), np.zeros((n, t, L)), np.ones((n, t))
            alpha[:, 0] = first * u[:, 0]
            for i in range(t):
                if i:
                    alpha[:, i] = np.where(mask[:, i, None], (alpha[:, i - 1] @ trans) * u[:, i], alpha[:, i - 1])
                scale[:, i] = np.where(mask[:, i], alpha[:, i].sum(axis=1), 1)
                alpha[:, i] /= scale[:, i, None]
            z = alpha[:, -1] @ last
            beta[:, t - 1] = last
            for i in range(t - 2, -1, -1):
                back = ((u[:, i + 1] * beta[:, i + 1]) @ trans.T) / scale[:, i + 1, None]
                beta[:, i] = np.where(mask[:, i + 1, None], back, last)
            gold = np.eye(L)[y]
            error = np.where(mask[:, :, None], alpha * beta / z[:, None, None] - gold, 0)
            grad = {"s": error[:, 0].sum(0) / n, "e": (alpha[:, -1] * last / z[:, None] - gold[np.arange(n), lens - 1]).sum(0) / n}
            ahead = np.where(mask[:, 1:, None], u[:, 1:] * beta[:, 1:] / (scale[:, 1:] * z[:, None])[:, :, None], 0)
            pair = np.einsum("nia,nib->ab", alpha[:, :-1], ahead, optimize=True) * trans
            np.add.at(pair, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), -1)
            grad["t"] = pair / n
            errors = (error / n).astype(np.float32).reshape(-1, L)
            by_word = np.zeros((b["words"], K, L), np.float32)
            for k in range(K):
                seen, heads = b["heads"][k]
                by_word[seen, k] = np.add.reduceat(errors[b["places"][k]], heads, axis=0)
            step += 1
            now, up, down = rate * (1 - 0.9 * step / steps), 1 - 0.9**step, 1 - 0.999**step

            def moved(p: np.ndarray, g: np.ndarray, first_moment: np.ndarray, second: np.ndarray) -> np.ndarray:
                g = (g + l2 * p).astype(np.float32)
                first_moment += 0.1 * (g - first_moment)
                second += 0.001 * (g * g - second)
                return p - now * (first_moment / up) / (np.sqrt(second / down) + 1e-8)

            rows = b["rows"]
            m1, m2 = m["w"][rows], v["w"][rows]
            w[rows] = moved(mine, np.add.reduceat(by_word[b["owner"]], b["firsts"], axis=0), m1, m2)
            m["w"][rows], v["w"][rows] = m1, m2
            for k in "tse":
                small[k] = moved(small[k], grad[k], m[k], v[k])
    return Crf(labels, features, np.ascontiguousarray(w.transpose(1, 0, 2)), *(small[k].astype(np.float32) for k in "tse"))


def decode_runs(unary: np.ndarray, starts: np.ndarray, ends: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Best labels of the runs [start, end) of positions; runs of like length go through Viterbi together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(starts)
    order = np.argsort(ends - starts, kind="stable")
    for at in range(0, len(order), 512):
        some = order[at : at + 512]
        n, lens = len(some), (ends - starts)[some]
        t = int(lens.max())
        idx = np.minimum(starts[some][:, None] + np.arange(t), len(unary) - 1)
        u = unary[idx]
        score = first[some] + u[:, 0]
        back = np.zeros((n, t, trans.shape[0]), np.int16)
        keep = np.zeros((n, t, trans.shape[0]), np.float32)
        keep[:, 0] = score
        for i in range(1, t):
            cand = score[:, :, None] + trans
            back[:, i] = cand.argmax(axis=1)
            score = cand.max(axis=1) + u[:, i]
            keep[:, i] = score
        tag = (keep[np.arange(n), lens - 1] + last[some]).argmax(axis=1)
        path = np.zeros((n, t), np.int64)
        for i in range(t - 1, -1, -1):
            live = i < lens
            path[live, i] = tag[live]
            if i:
                tag = np.where(live, back[np.arange(n), i, tag], tag)
        for row, r in enumerate(some):
            out[r] = path[row, : lens[row]]
    return out
