"""Cross-validation of a classifier's settings on labelled rows that may be learned from; held-out rows take no part.

    python -m relspan.llm.tuning /path/to/tables [rows of either label]
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import SparkSession

from relspan.llm import quality, toxicity
from relspan.llm.common import held_out, table

#: What is tried: every combination, where a classifier's own settings come first.
TRIED = {
    "toxic": {"l1": (8.0, 5.0, 12.0, 3.0), "alpha": (0.5, 1.0, 2.0)},
    "quality": {"passes": (12, 6, 20), "decay": (1e-3, 1e-4), "word_decay": (1e-3, 1e-2, 1e-4)},
}
CLASSIFIERS = {"toxic": (toxicity._featurize, toxicity.ftrl, toxicity.score_bags, 0.3), "quality": (quality._featurize, quality.attention_mil, quality.score_bags, quality.REJECT_BELOW)}
FOLDS = (0, 1, 3)  # the remainders of crc32 modulo 4 but that of held-out rows


def cross_validated(rows: list[tuple[int, int, bytes]], fit: Callable, score: Callable, at: float) -> tuple[int, int, float]:
    """(wrongly 0, wrongly 1, mean log loss) of (fold, label, features) rows, each scored by a model that hasn't seen its fold."""
    missed = false = 0
    loss = []
    for fold in FOLDS:
        model = fit([(y, x) for f, y, x in rows if f != fold])
        mine = [(y, x) for f, y, x in rows if f == fold]
        for (y, _), p in zip(mine, score(model, [x for _, x in mine])):
            missed += y == 1 and p < at
            false += y == 0 and p >= at
            loss.append(-np.log(np.clip(p if y else 1 - p, 1e-6, 1)))
    return int(missed), int(false), float(np.mean(loss))


def main(sf_dir: str, most: int = 1500) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").getOrCreate()
    labels = table(spark, sf_dir, "labels")
    for label, (featurize, fit, score, at) in CLASSIFIERS.items():
        some = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels.select("doc_id", label), "doc_id").where(~held_out(labels["doc_id"])).orderBy("doc_id")
        rows, count = [], {0: 0, 1: 0}
        for r in some.toLocalIterator():
            if count[r[label]] < most:
                count[r[label]] += 1
                rows.append((zlib.crc32(str(r.doc_id).encode()) % 4, r[label], featurize([r.text])[0]))
        print(label, count, flush=True)
        for values in product(*TRIED[label].values()):
            own = dict(zip(TRIED[label], values))
            missed, false, loss = cross_validated(rows, lambda x, own=own: fit(x, **own), score, at)
            print(f"  {own}: wrongly 0 {missed}, wrongly 1 {false}, log loss {loss:.4f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
