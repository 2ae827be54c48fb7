"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over some twenty statistics of a text. Each partition sums its
part of the normal equations; the driver adds a fixed number of such parts, of a fixed size, and solves
them. A fold that the fit does not see calibrates the scores by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, fold, give_back, text_or_empty

#: Random features, ridge penalty, kernel width in units of sqrt(number of statistics), and the seed.
FEATURES, RIDGE, WIDTH, SEED = 256, 1.0, 0.7, 20
#: Labelled rows that the fit and the calibration use at most, drawn by a hash of the id; the bound of the fit.
MAX_LABELLED = 200_000
PARTS, BINS = 8, 2000
STATISTICS = (
    "log_bytes log_words word_length upper digit symbol bar exclaim stop comma newline nonascii "
    "distinct adjacent_equal window_equal dup_lines log_line"
).split()
_UPPER, _DIGIT, _SYMBOL, _HIGH = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>", bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all 0 for an empty one."""
    from math import log1p
    from operator import eq

    b = text.encode()
    n = len(b)
    words = b.split()
    if not words:
        return [0.0] * len(STATISTICS)
    k = len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    return [
        log1p(n), log1p(k), len(b"".join(words)) / k, share(_UPPER), share(_DIGIT), share(_SYMBOL),
        b.count(b"|") / n, b.count(b"!") / n, b.count(b".") / n, b.count(b",") / n, b.count(b"\n") / n, share(_HIGH),
        len(set(words)) / k, sum(map(eq, words, words[1:])) / k, sum(map(eq, words, words[2:])) / k,
        1 - len(set(lines)) / len(lines), log1p(k / len(lines)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<float>) for each row; a null text counts as empty."""

    def measured(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(r, np.float32) for r in rows], pa.list_(pa.float32()))], ["doc_id", "x"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(measured, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<float>")


@dataclass
class Model:
    mean: list
    scale: list
    weights: list | None
    knots: list
    values: list
    seed: int = SEED
    features: int = FEATURES
    width: float = WIDTH

    def lift(self, x):
        """Random Fourier features of rows of statistics, and a constant."""
        import numpy as np

        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6)
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / (self.width * np.sqrt(z.shape[1])), (z.shape[1], self.features))
        phase = rng.uniform(0, 2 * np.pi, self.features)
        return np.hstack([np.sqrt(2 / self.features) * np.cos(z @ w + phase), np.ones((len(z), 1))])

    def raw(self, x):
        import numpy as np

        return self.lift(x) @ np.array(self.weights)

    def score(self, x):
        import numpy as np

        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.interp(raw, self.knots, self.values) if self.knots else np.clip(raw, 0, 1)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Knots and non-decreasing values through (score, weight, positives), pooled where they would decrease."""
    blocks: list[list[float]] = []  # weighted score sum, weight, positives
    for s, n, y in sorted(points):
        blocks.append([s * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[1] for b in blocks], [min(max(b[2] / b[1], 0.0), 1.0) for b in blocks]


def known_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED, held_fold: int = 0) -> DataFrame:
    """(doc_id, y): the labels that the fit may see, ``max_labelled`` or hardly more, with a broadcast hint (some 16 bytes each).

    Of several labels of a document the lower counts; labels other than 0 and 1, null ids and the held-out fold are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.where(fold(F.col("doc_id")) != held_fold)
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    return F.broadcast(known)


def fit(stats: DataFrame, known: DataFrame, calibration_fold: int = 1) -> Model:
    """Fit on the documents (doc_id, x) with labels (doc_id, y); ``calibration_fold`` calibrates and does not fit.

    Without labels of both kinds every score is 0.5.
    """
    import numpy as np

    d = len(STATISTICS)
    store = Store(stats.sparkSession)
    rows = store.put(stats.join(known, "doc_id").select(fold(F.col("doc_id")).alias("fold"), "x", "y").repartition(PARTS))
    own = rows.where(F.col("fold") != calibration_fold)
    moments = own.agg(F.count("*"), F.avg("y"), *(f(F.col("x")[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(d))).first()
    if not moments[0] or not 0 < moments[1] < 1:
        return Model([0.0] * d, [1.0] * d, None, [], [])
    model = Model(list(moments[2 : 2 + d]), [max(s, 1e-3) for s in moments[2 + d :]], [], [], [])
    share = moments[1]

    def equations(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = np.zeros((FEATURES + 1, FEATURES + 1))
        b = np.zeros(FEATURES + 1)
        for t in batches:
            if t.num_rows:
                z = model.lift(np.array(t.column(0).to_pylist(), float))
                y = t.column(1).to_numpy()
                # both classes weigh the same: the rarer is what the score must tell
                w = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))[:, None]
                a += z.T @ (z * w)
                b += (z * w).T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    parts = own.select("x", "y").mapInArrow(equations, "a binary, b binary").collect()  # a part has a fixed size, and there are as many as files read
    a = sum(np.frombuffer(p.a).reshape(FEATURES + 1, -1) for p in parts)
    b = sum(np.frombuffer(p.b) for p in parts)
    model.weights = np.linalg.solve(a + RIDGE * np.eye(len(b)), b).tolist()

    def raw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in batches:
            if t.num_rows:
                bins = np.clip(np.round(model.raw(np.array(t.column(0).to_pylist(), float)) * (BINS // 2)), -BINS, BINS)
                yield pa.RecordBatch.from_arrays([pa.array(bins / (BINS // 2)), t.column(1)], ["s", "y"])

    held = rows.where(F.col("fold") == calibration_fold).select("x", "y").mapInArrow(raw, "s double, y double")
    points = [(r.s, float(r.n), r.p) for r in held.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()]  # 2 * BINS + 1 rows at most
    if 0 < sum(p for *_, p in points) < sum(n for _, n, _ in points):
        model.knots, model.values = isotonic(points)
    store.drop(rows)
    return model


def scorer(model: Model):
    """A column function text -> score, which sends only the texts to Python."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(model.score(np.array([statistics(t or "") for t in texts], np.float32).astype(float).reshape(len(texts), -1)))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``. Two passes, of which the first
    measures the labelled documents alone; no shuffle of texts."""
    known = known_labels(labels, max_labelled)
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(known.select("doc_id"), "doc_id", "left_semi")
    model = fit(document_statistics(labelled), known)
    return docs.where(scorer(model)(text_or_empty(text_col)) >= threshold)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Empty and null texts have statistics of 0 and get their score from them. Null ids and repeated rows stay;
    other columns are not read, and neither lang, source nor the id enters a score. An empty table gives
    an empty result. Statistics (72 bytes a document) are written once; texts are read once and never shuffled.
    """
    store = Store(docs.sparkSession)
    stats = store.put(document_statistics(docs, id_col, text_col))
    model = fit(stats, known_labels(labels, max_labelled))

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in batches:
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(model.score(np.array(t.column(1).to_pylist(), float)))], ["doc_id", "score"])

    out = stats.mapInArrow(scored, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")
    return out.select(F.col("doc_id").alias(id_col), (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
