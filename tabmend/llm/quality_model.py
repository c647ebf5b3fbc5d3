"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Boosting goes round the features: every step fits one shallow
tree to one feature's gradients and adds it to that feature's table, so a document's score is a
sum of table entries.  What is left then trains tables over the pairs of features that explain
most of it.  Scoring looks up bins and adds, on whole columns at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import Workspace, full, named, shipped, words

shipped(__name__)

#: Most labelled rows that training takes, those of the smallest hashes of their ids.
SAMPLE_ROWS = 50_000
BINS, ROUNDS, LEAVES, RATE, RIDGE = 64, 120, 3, 0.1, 1.0
PAIRS, PAIR_BINS, PAIR_ROUNDS = 5, 16, 40
THRESHOLD = 0.3
FOLDS = 5

FEATURES = ("words", "length", "symbols", "marks", "capitals", "digits", "variety", "lines", "per_line", "bars", "stops")


def held_out(id_col: Column) -> Column:
    """Rows that training never sees; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == 0


def features(docs: DataFrame, id_col: str, text_col: str, rows: bool = False) -> DataFrame:
    """(id, one double per feature) of every whole text; an empty text has zeros.

    With ``rows``, ``id`` is the whole row instead."""
    key = F.struct(*[named(c) for c in docs.columns]) if rows else named(id_col)
    df = docs.select(key.alias("id"), full(named(text_col)).alias("text"))
    df = df.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "id",
        F.size("w").cast("double").alias("n"),
        F.size(F.array_distinct("w")).cast("double").alias("different"),
        F.length(F.array_join("w", "")).cast("double").alias("chars"),
        F.regexp_count("text", F.lit(r"[#*$%&<>@^~=_\\{}\[\]]")).cast("double").alias("symbols"),
        F.regexp_count("text", F.lit(r"[!?]")).cast("double").alias("marks"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("double").alias("capitals"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("double").alias("digits"),
        F.regexp_count("text", F.lit(r"\|")).cast("double").alias("bars"),
        F.regexp_count("text", F.lit(r"[,.;:'\"()\-]")).cast("double").alias("stops"),
        lines.alias("lines"),
    ).withColumns({"n_lines": F.size("lines").cast("double"), "d_lines": F.size(F.array_distinct("lines")).cast("double")})
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1.0))
    return df.select(
        "id",
        F.log1p("n").alias("words"), share("chars", "n").alias("length"), share("symbols", "n").alias("symbols"),
        share("marks", "n").alias("marks"), share("capitals", "chars").alias("capitals"),
        share("digits", "chars").alias("digits"), share("different", "n").alias("variety"),
        (1 - share("d_lines", "n_lines")).alias("lines"), F.log1p(share("n", "n_lines")).alias("per_line"),
        share("bars", "n").alias("bars"), share("stops", "n").alias("stops"),
    )


@dataclass
class Model:
    """Cuts and tables; ``pairs`` maps two features to coarser cuts and a table of both."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, ca, cb, table in self.pairs:
            total += table[np.searchsorted(ca, x[:, a], side="right"), np.searchsorted(cb, x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    different = np.unique(values)
    middle = (different[1:] + different[:-1]) / 2
    if len(middle) < bins:
        return middle
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first tree over ordered bins: the step of each bin."""
    gs, hs = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda i, j: (gs[j] - gs[i]) ** 2 / (hs[j] - hs[i] + RIDGE)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for i, j in parts:
            if j - i > 1:
                m = np.arange(i + 1, j)
                gain = worth(i, m) + worth(m, j) - worth(i, j)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (i, int(m[k]), j))
        if best[1] is None:
            break
        i, m, j = best[1]
        parts.remove((i, j))
        parts += [(i, m), (m, j)]
    step = np.zeros(len(g))
    for i, j in parts:
        step[i:j] = (gs[j] - gs[i]) / (hs[j] - hs[i] + RIDGE)
    return step


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of both features into four parts: its gain, and the step of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(cg.shape) < 2:
        return 0.0, np.zeros_like(g)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        low, right, down, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, right - low, down - low, all_ - right - down + low]

    gp, hp = parts(cg), parts(ch)
    gain = sum(a * a / (b + RIDGE) for a, b in zip(gp, hp, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty_like(g)
    for rows, cols, k in ((slice(0, i + 1), slice(0, j + 1), 0), (slice(0, i + 1), slice(j + 1, None), 1),
                          (slice(i + 1, None), slice(0, j + 1), 2), (slice(i + 1, None), slice(j + 1, None), 3)):
        step[rows, cols] = gp[k][i, j] / (hp[k][i, j] + RIDGE)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Trains on rows in the given order; without rows every score is one half."""
    n, positive = len(y), float(y.sum())
    odds = (positive + 1) / (n - positive + 1)
    model = Model(base=float(np.log(odds)))
    if not n or positive in (0.0, float(n)):
        model.cuts, model.tables = [np.array([])] * x.shape[1], [np.zeros(1)] * x.shape[1]
        return model
    model.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    total = np.full(n, model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = gradients()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size), LEAVES)
            model.tables[j] += step
            total += step[b]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = gradients()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = cell[a] * shape[1] + cell[b]
        size = shape[0] * shape[1]
        return at, np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape)

    gains = sorted(((-_cross(*grids(a, b)[1:])[0], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    chosen = [(a, b) for gain, a, b in gains[:PAIRS] if gain < 0]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            at, g, h = grids(*p)
            step = RATE * _cross(g, h)[1]
            tables[p] += step
            total += step.ravel()[at]
    model.pairs = [(a, b, coarse[a], coarse[b], tables[a, b]) for a, b in chosen]
    return model


def train(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows outside the held-out fold.

    Rows without a label are not used; an id with several labels has their majority, 1 on a tie."""
    marks = labels.select(named(id_col).alias("l_id"), named(label_col).alias("y")).filter("l_id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("l_id").agg((F.avg(F.col("y").cast("double")) >= 0.5).cast("double").alias("y"))
    known = rows.filter(~held_out(F.col("id"))).join(marks, F.col("id") == F.col("l_id"))
    sample = known.orderBy(F.xxhash64("id"), "id", *FEATURES).limit(sample_rows).select("y", *FEATURES).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(np.float64), sample["y"].to_numpy(np.float64))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted.  Only texts are inputs of a score.

    Null and empty texts are scored like any other.  Without labels, or with labels of one
    kind, all rows get the same score.  Equal texts get equal scores.  Empty tables give no rows."""
    space = Workspace(docs.sparkSession)
    rows = space.stored(features(docs, id_col, text_col), "features")
    score = scorer(train(rows, labels, id_col, label_col, sample_rows))
    rows = rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    space = Workspace(docs.sparkSession)
    # counting twice costs less than moving the texts to their labels
    known = space.stored(features(docs, id_col, text_col), "features")
    score = scorer(train(known, labels, id_col, label_col, sample_rows))
    return features(docs, id_col, text_col, rows=True).filter(score >= threshold).select("id.*")


def scorer(model: Model) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(model.score(np.column_stack([c.to_numpy(np.float64) for c in columns])))

    return scored(*FEATURES)
