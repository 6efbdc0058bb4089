"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins.  Boosted shallow trees, one feature at a
time in turn, add up to one lookup table a feature; then trees over two
features add up to a few tables for pairs, chosen by how much residual they
explain.  A score is a sum of table entries through a logistic function.

Only the fit runs on the driver, over a bounded sample of labelled rows
(``FIT_ROWS``); features and scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, WORD, let, load, materialize, words_of

#: Labelled rows that a fit takes at most: documented bound of the training sample.
FIT_ROWS = 100_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SMOOTH = 150, 60, 0.15, 3, 4.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

FEATURES = ("log_words", "mean_word", "symbols", "bars", "caps", "marks", "digits", "stops", "unique", "dup_lines", "line_words", "low_ascii")


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` and ``x``, an array of ``FEATURES``, from the text alone.

    Null is empty; every share of an empty text is 0.
    """
    own = docs.select(*[docs[k].alias(k) for k in keep], F.coalesce(docs["text"], F.lit("")).alias("__t"))
    own = own.withColumn("__w", words_of(F.col("__t")))
    count = lambda p: F.regexp_count("__t", F.lit(p)).cast("double")
    n, chars = F.size("__w").cast("double"), F.length(F.array_join("__w", "")).cast("double")
    per = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = let(lines, lambda x: F.struct(F.size(x).cast("double").alias("all"), F.size(F.array_distinct(x)).cast("double").alias("own")))
    own = own.withColumn("__l", n_lines)
    columns = {
        "log_words": F.log1p(n),
        "mean_word": per(chars, n),
        "symbols": per(count(r"[#*$%&<>@=_{}]"), chars),
        "bars": per(count(r"\|"), n),
        "caps": per(count(r"\p{Lu}"), chars),
        "marks": per(count(r"[!?]"), n),
        "digits": per(count(r"[0-9]"), chars),
        "stops": per(count(r"[.,;:]"), n),
        "unique": per(F.size(F.array_distinct("__w")).cast("double"), n),
        "dup_lines": per(F.col("__l.all") - F.col("__l.own"), F.col("__l.all")),
        "line_words": F.log1p(per(n, F.col("__l.all"))),
        "low_ascii": per(count(r"[a-z]"), chars),
    }
    return own.select(*keep, F.array(*[columns[k].cast("double") for k in FEATURES]).alias("x"))


@dataclass
class Additive:
    """Lookup tables: ``cuts[f]`` are bin edges, ``tables[f]`` the bins' scores; pairs have coarser edges and square tables."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.empty(0)


def _leaves(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of the best tree over ordered bins with ``leaves`` leaves, grown split by split."""
    bounds = [(0, len(grad))]
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SMOOTH)
    while len(bounds) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(bounds):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], k, int(at[j]))
        if best[1] is None:
            break
        a, b = bounds.pop(best[1])
        bounds += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in bounds:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SMOOTH)
    return out


def _quarters(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best cross cut of a square of bins."""
    g, h = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (grad, hess))
    n, m = grad.shape
    best = (0.0, np.zeros_like(grad))
    for i in range(1, n):
        for j in range(1, m):
            out, gain = np.zeros_like(grad), 0.0
            for a, b in ((0, i), (i, n)):
                for c, d in ((0, j), (j, m)):
                    gs = g[b, d] - g[a, d] - g[b, c] + g[a, c]
                    hs = h[b, d] - h[a, d] - h[b, c] + h[a, c]
                    out[a:b, c:d] = gs / (hs + SMOOTH)
                    gain += gs * gs / (hs + SMOOTH)
            if gain > best[0]:
                best = (gain, out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit on rows ``x`` and 0/1 labels ``y``; with no rows or one label only, a constant."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(rate / (1 - rate))), [np.empty(0)] * width, [np.zeros(1)] * width, [np.empty(0)] * width, [], [])
    if len(y) == 0 or len(np.unique(y)) < 2:
        return model
    model.cuts = [edges(x[:, f], BINS) for f in range(width)]
    model.pair_cuts = [edges(x[:, f], PAIR_BINS) for f in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.pair_cuts)]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            r, w = slopes()
            size = len(model.tables[f])
            step = RATE * _leaves(np.bincount(bins[f], r, size), np.bincount(bins[f], w, size), LEAVES)
            model.tables[f] += step
            margin += step[bins[f]]
    square = lambda a, b, v: np.bincount(coarse[a] * (len(model.pair_cuts[b]) + 1) + coarse[b], v, (len(model.pair_cuts[a]) + 1) * (len(model.pair_cuts[b]) + 1)).reshape(len(model.pair_cuts[a]) + 1, -1)
    r, w = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: -_quarters(square(*p, r), square(*p, w))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            r, w = slopes()
            step = RATE * _quarters(square(a, b, r), square(a, b, w))[1]
            model.pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(table: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, x, quality) of labelled rows outside the held-out fold, ``most`` at most by hash of the id.

    The hash draws six standard deviations fewer than ``most``, so that more
    than that do not come.  Rows with a null id or label teach nothing; of
    several labels of a document the greatest counts, of several feature rows
    the least.
    """
    known = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > most:
        wanted = max(0.0, most - 6 * most**0.5)
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * wanted / n))
    return table.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality"))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other, by their features.  Null
    ids are never held out.  Repeated rows get equal scores.  Without labels of
    both kinds every score is the smoothed share of label 1.
    """
    table = materialize(features(docs, "doc_id"), "quality-features")
    sample = training_rows(table, labels, most).toPandas()
    x = np.stack(sample["x"].to_list()) if len(sample) else np.empty((0, len(FEATURES)))
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable") if len(sample) else np.empty(0, dtype=int)
    model = fit(x[order], sample["quality"].to_numpy(dtype=float)[order])

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.array(model.scores(flat), pa.float64())

    out = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
