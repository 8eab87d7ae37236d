"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: words, words cut to their first four, five and six bytes, bigrams, and skip-grams
over one and two words, hashed to 2**BITS coordinates. Each coordinate has its own learning rate; the L1
term leaves few weights other than zero, and those alone are broadcast (2**BITS pairs at most).

Defined cases: null and empty texts get the score of the bias; labels that are null or not 0/1 are unused; with no
labels at all every score is 0.5; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm.bytewords import LETTERS_DIGITS, mix, slices, span_hash, words_of
from relspan.llm.common import held_out
from relspan.llm.fitting import FIT_ROWS, fit_in_one_task, fitting_sample, score_with

BITS = 20
CUTS = (4, 5, 6)
#: Chosen by cross-validation on rows that aren't held out (tuning.py).
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 8.0, 0.5, 5


def feature_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every feature of every text, repeats included."""
    w = words_of([x.lower() for x in texts], LETTERS_DIGITS)
    h, d = w.hash, w.doc
    found, of = [h], [d]
    for cut in CUTS:
        found.append(span_hash(w, w.start, np.minimum(w.end, w.start + cut)) + np.uint64(cut))
        of.append(d)
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9E6C63D0876A9A47), (3, 0xC2B2AE3D27D4EB4F)):
        same = d[gap:] == d[:-gap]
        found.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        of.append(d[gap:][same])
    return np.concatenate(of), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _featurize(texts: list[str | None]) -> list[bytes]:
    out = []
    for part in slices(texts):
        d, f = feature_slots(part)
        u = np.unique((d << BITS) | f)
        cuts = np.searchsorted(u >> BITS, np.arange(1, len(part)))
        out += [(x & ((1 << BITS) - 1)).astype(np.int32).tobytes() for x in np.split(u, cuts)]
    return out


def ftrl(rows: list[tuple[int, bytes]], alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) after ``passes`` over the rows in a fixed shuffled order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(own) <= l1] = 0.0
        free = i == size  # the bias has no penalty
        w[free] = -own[free] / ((beta + np.sqrt(n[i][free])) / alpha)
        return w

    read = [(y, np.append(np.frombuffer(x, np.int32), size)) for y, x in rows]
    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(read)):
            y, i = read[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    all_w = weights(np.arange(size + 1))
    kept = np.flatnonzero(all_w[:size])
    return kept.astype(np.int32), all_w[kept].astype(np.float32), float(all_w[size])


def score_bags(model: tuple, rows: list[bytes]) -> np.ndarray:
    """Scores of texts that _featurize has read."""
    kept, weights, bias = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[kept] = weights
    return np.array([1 / (1 + np.exp(-np.clip(bias + dense[np.frombuffer(x, np.int32)].sum(dtype=float), -35, 35))) for x in rows])


def _score(model: tuple, texts: list[str | None]) -> list[float]:
    kept, weights, bias = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[kept] = weights
    out: list[float] = []
    for part in slices(texts):
        d, f = feature_slots(part)
        hit = dense[f] != 0
        u = np.unique((d[hit] << BITS) | f[hit])
        total = bias + np.bincount(u >> BITS, dense[u & ((1 << BITS) - 1)], len(part))
        out += (1 / (1 + np.exp(-np.clip(total, -35, 35)))).tolist()
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """docs with ``score``: likelihood that labels.toxic is 1, learned from at most 2 * ``most`` labelled rows."""
    model = fit_in_one_task(fitting_sample(docs, labels, "toxic", most), _featurize, ftrl)
    return score_with(docs, model, _score)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), labels)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
