"""Quality: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded by a learned tanh layer over its shape and repetition
measures and over the sum of learned vectors of its hashed words and word pairs; gated attention weighs the passages, and a logistic unit scores the
weighted sum. Only document labels are used; attention learns which passages decide.

Defined cases: a text with no words is a bag of one all-zero passage; labels that are null or not 0/1 are unused; with no
labels at all every score is 1, so nothing is rejected unlearned; other columns are kept as they are. A score depends on the text alone, not on
the texts that stand beside it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm.bytewords import NON_SPACE, mix, slices, words_of
from relspan.llm.common import held_out
from relspan.llm.fitting import FIT_ROWS, fit_in_one_task, fitting_sample, score_with

PASSAGE = 40
HIDDEN, GATE, PASSES, BATCH, RATE, DECAY = 12, 8, 12, 64, 0.02, 1e-3
#: Words and pairs of words have 2**BITS vectors; those start at zero, so words that no labelled text has say nothing.
BITS, WORD_DECAY = 13, 1e-3
REJECT_BELOW = 0.7

_byte = np.arange(256)
_CLASSES = np.stack(
    [(_byte >= 65) & (_byte <= 90), (_byte >= 97) & (_byte <= 122), (_byte >= 48) & (_byte <= 57), _byte >= 128, np.isin(_byte, [44, 46, 59, 58, 39]), np.isin(_byte, [33, 63]), np.isin(_byte, [124, 95, 61, 60, 62, 47, 92, 123, 125, 91, 93]), np.isin(_byte, [35, 36, 37, 38, 42, 64, 94, 126, 43])]
).astype(np.int32)
N_FEATURES = len(_CLASSES) + 8


class Passages(NamedTuple):
    x: np.ndarray  # measures, a row a passage
    doc: np.ndarray  # number of the passage's text, ascending
    word: np.ndarray  # slots of words and pairs of words
    of: np.ndarray  # number of the passage of each of these


def passages(texts: list[str]) -> Passages:
    """Whole texts are cut; every text has a passage."""
    w = words_of(texts, NON_SPACE, fold=True)
    none = np.empty(0, np.int64)
    if not len(w.start):
        return Passages(np.zeros((len(texts), N_FEATURES)), np.arange(len(texts)), none, none)
    n = len(w.start)
    first = np.searchsorted(w.doc, np.arange(len(texts)))
    opens = (np.arange(n) - first[w.doc]) % PASSAGE == 0
    at = np.flatnonzero(opens)
    of = np.cumsum(opens) - 1
    last = np.append(at[1:], n) - 1
    size = (last - at + 1).astype(float)
    lo, hi = w.start[at], w.end[last]
    n_bytes = np.maximum(hi - lo, 1).astype(float)
    cols = []
    for c in _CLASSES:
        total = np.concatenate(([0], np.cumsum(c[w.data])))
        cols.append((total[hi] - total[lo]) / n_bytes)
    gap = np.concatenate(([0], np.cumsum(w.data == 10)))
    pair = np.sort((of.astype(np.uint64) << np.uint64(40)) ^ (w.hash >> np.uint64(24)))
    distinct = np.bincount((pair[np.append(True, pair[1:] != pair[:-1])] >> np.uint64(40)).astype(np.int64), minlength=len(at))[: len(at)]
    same = np.zeros(n)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    # words whose pair with the next word stood earlier in the same text
    two = w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:]
    of_text = two + w.doc[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    again = np.zeros(n)
    order = np.argsort(of_text, kind="stable")
    again[order[1:]] = of_text[order][1:] == of_text[order][:-1]
    again[:-1] *= w.doc[1:] == w.doc[:-1]
    length = (w.end - w.start).astype(float)
    cap = (w.data[w.start] >= 65) & (w.data[w.start] <= 90)
    mean = lambda x: np.bincount(of, x, len(at)) / size
    cols += [distinct / size, mean(same), mean(again), mean(length) / 10, mean(cap), mean(length == 1), (gap[hi] - gap[lo]) / size, np.log1p(size) / 4]
    x, doc = np.stack(cols, 1), w.doc[at]
    within = of[1:] == of[:-1]
    word = np.concatenate([w.hash, mix(two)[within]]) >> np.uint64(64 - BITS)
    of = np.concatenate([of, of[1:][within]])
    bare = np.setdiff1d(np.arange(len(texts)), doc)
    if len(bare):
        order = np.argsort(np.concatenate([doc, bare]), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        x, doc, of = np.concatenate([x, np.zeros((len(bare), N_FEATURES))])[order], np.concatenate([doc, bare])[order], place[of]
    return Passages(x, doc, word.astype(np.int64), of)


def _featurize(texts: list[str | None]) -> list[bytes]:
    out = []
    for part in slices(texts):
        p = passages(part)
        by_doc = np.argsort(p.doc[p.of], kind="stable")
        word, of = p.word[by_doc], p.of[by_doc]
        first = np.searchsorted(p.doc, np.arange(len(part) + 1))
        cuts = np.searchsorted(p.doc[of], np.arange(len(part) + 1))
        for k in range(len(part)):
            mine = slice(cuts[k], cuts[k + 1])
            out.append(_packed(p.x[first[k] : first[k + 1]], word[mine], of[mine] - first[k]))
    return out


def _packed(x: np.ndarray, word: np.ndarray, of: np.ndarray) -> bytes:
    return b"".join([np.array([len(x)], "<u4").tobytes(), x.astype("<f4").tobytes(), word.astype("<u2").tobytes(), of.astype("<u4").tobytes()])


def _unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(bag, "<u4", 1)[0])
    at = 4 + n * N_FEATURES * 4
    words = (len(bag) - at) // 6
    return np.frombuffer(bag, "<f4", n * N_FEATURES, 4).reshape(n, -1).astype(float), np.frombuffer(bag, "<u2", words, at).astype(np.int64), np.frombuffer(bag, "<u4", words, at + 2 * words).astype(np.int64)


def _joined(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Passages:
    sizes = np.array([len(x) for x, _, _ in bags])
    before = np.cumsum(sizes) - sizes
    return Passages(np.concatenate([x for x, _, _ in bags]), np.repeat(np.arange(len(bags)), sizes), np.concatenate([w for _, w, _ in bags]), np.concatenate([of + b for (_, _, of), b in zip(bags, before)]))


def _forward(m: dict, p: Passages, n: int) -> dict:
    x = np.clip((p.x - m["mean"]) / m["std"], -6, 6)
    share = 1 / np.sqrt(np.maximum(np.bincount(p.of, minlength=len(x)), 1))
    words = np.stack([np.bincount(p.of, v[p.word], len(x)) for v in m["words"].T], 1) * share[:, None]
    h = np.tanh(x @ m["we"] + words + m["be"])
    t, s = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (t * s) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, np.searchsorted(p.doc, np.arange(n)))[p.doc])  # of each bag its own maximum
    a = e / np.bincount(p.doc, e, n)[p.doc]
    bag = np.stack([np.bincount(p.doc, a * h[:, k], n) for k in range(h.shape[1])], 1)
    return {"x": x, "share": share, "h": h, "t": t, "s": s, "a": a, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(bag @ m["w"] + m["b"], -35, 35)))}


def _gradient(m: dict, p: Passages, y: np.ndarray) -> dict:
    """Of the mean log loss of the bags, by every weight."""
    f = _forward(m, p, len(y))
    dz = (f["p"] - y) / len(y)
    dbag = np.outer(dz, m["w"])[p.doc]
    da = (f["h"] * dbag).sum(1)
    de = f["a"] * (da - np.bincount(p.doc, f["a"] * da, len(y))[p.doc])
    dt, ds = np.outer(de, m["a"]) * f["s"] * (1 - f["t"] ** 2), np.outer(de, m["a"]) * f["t"] * f["s"] * (1 - f["s"])
    dx = (f["a"][:, None] * dbag + dt @ m["v"].T + ds @ m["u"].T) * (1 - f["h"] ** 2)
    apart = dx * f["share"][:, None]
    words = np.stack([np.bincount(p.word, v[p.of], len(m["words"])) for v in apart.T], 1)
    return {"w": f["bag"].T @ dz, "b": dz.sum(), "a": (f["t"] * f["s"]).T @ de, "v": f["h"].T @ dt, "u": f["h"].T @ ds, "we": f["x"].T @ dx, "be": dx.sum(0), "words": words}


def fresh_weights(mean: np.ndarray, std: np.ndarray) -> dict:
    rng = np.random.default_rng(11)
    near_zero = lambda *shape: rng.normal(0, 0.3, shape)
    return {"mean": mean, "std": std, "we": near_zero(N_FEATURES, HIDDEN), "be": np.zeros(HIDDEN), "v": near_zero(HIDDEN, GATE), "u": near_zero(HIDDEN, GATE), "a": near_zero(GATE), "w": near_zero(HIDDEN), "b": np.zeros(()), "words": np.zeros((1 << BITS, HIDDEN))}


def attention_mil(rows: list[tuple[int, bytes]], passes: int = PASSES, rate: float = RATE, decay: float = DECAY, word_decay: float = WORD_DECAY) -> dict:
    """Adam on the mean log loss of the bags, gradients by hand."""
    if len({y for y, _ in rows}) < 2:
        return {"only": float(rows[0][0]) if rows else 1.0}
    bags, y = [_unpacked(x) for _, x in rows], np.array([y for y, _ in rows], float)
    every = np.concatenate([x for x, _, _ in bags])
    m = fresh_weights(every.mean(0), every.std(0) + 1e-3)
    learned = [k for k in m if k not in ("mean", "std")]
    first, second, step = {k: np.zeros_like(m[k]) for k in learned}, {k: np.zeros_like(m[k]) for k in learned}, 0
    rng = np.random.default_rng(13)
    for _ in range(passes):
        order = rng.permutation(len(bags))
        for cut in range(0, len(order), BATCH):
            own = order[cut : cut + BATCH]
            g = _gradient(m, _joined([bags[k] for k in own]), y[own])
            step += 1
            for k in learned:
                grad = g[k] + (word_decay if k == "words" else decay) * m[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def score_bags(m: dict, bags: list[bytes]) -> np.ndarray:
    """Scores of texts that _featurize has read."""
    return np.array([m["only"] if "only" in m else _forward(m, _joined([_unpacked(x)]), 1)["p"][0] for x in bags])


def _score(m: dict, texts: list[str | None]) -> list[float]:
    if "only" in m:
        return [m["only"]] * len(texts)
    out: list[float] = []
    for part in slices(texts):
        out += _forward(m, passages(part), len(part))["p"].tolist()
    return out


def score_quality(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, name: str = "score") -> DataFrame:
    """docs with ``name``: likelihood that labels.quality is 1, learned from at most 2 * ``most`` labelled rows."""
    model = fit_in_one_task(fitting_sample(docs, labels, "quality", most), _featurize, attention_mil)
    return score_with(docs, model, _score, name)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_quality(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), labels)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
