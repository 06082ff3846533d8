"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of a whole text (shares of character classes, word and line repetition, ...) are mapped to
cos(Wx + b), which approximates a Gaussian kernel. Each partition sums its share of the normal
equations; the driver solves one small system whose size is a parameter, not the data's. Scores are
calibrated isotonically on labelled rows that the ridge fit has not seen.

Defined results: a null or empty text has all-zero statistics and is scored like any other. Labels
that are null, or whose document is missing, teach nothing; repeated label rows count as often as
they stand. Without labels every score is 0.5. Columns beside id and text are passed through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoloom.llm.common import calibrated, calibration, computed, learned_from, stored, texts_of, words_of

CLASSES = 8
_RUNS = re.compile(r"([^\w\s])\1{1,}")


def _class_table() -> np.ndarray:
    """Code point (up to 0x2FFF; others as letters) -> space, newline, digit, upper, lower, stop, symbol, other."""
    table = np.full(0x3000, 7, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s == "\n":
            table[c] = 1
        elif s.isspace():
            table[c] = 0
        elif s.isdigit():
            table[c] = 2
        elif s.isupper():
            table[c] = 3
        elif s.isalpha():
            table[c] = 4
        elif s in ".,;:'\"?-()":
            table[c] = 5
        elif c < 128:
            table[c] = 6
    return table


_TABLE = _class_table()


def statistics(text: str | None) -> list[float]:
    """The numbers that describe a text; all zero when it has no word."""
    words = words_of(text)
    if not words:
        return [0.0] * N_STATISTICS
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(_TABLE[np.minimum(codes, 0x2FFF)], minlength=CLASSES) / len(codes)
    n = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    top = counts.most_common(3)
    runs = len(_RUNS.findall(text))
    return [
        *share.tolist(),
        np.log1p(n),
        len(counts) / n,
        pairs / max(1, n - 1),
        repeats / n,
        top[0][1] / n,
        sum(c for _, c in top) / n,
        lengths.mean(),
        lengths.std(),
        runs / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        text.count("|") / n,
        text.count(".") / n,
        float(sum(v for v in counts.values() if v > 1)) / n,
    ]


N_STATISTICS = CLASSES + 14


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, stats array<double> for every row; and row, if row_col (a long) is given."""
    kept = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).alias("id"), *kept, F.col(text_col).alias("text"))
    return computed(rows, rows.columns[:-1], {"stats": "array<double>"}, lambda: lambda b: [[statistics(t) for t in texts_of(b)]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)
        return np.hstack([np.ones((len(x), 1)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.coefficients


def gathered(parts: DataFrame) -> DataFrame:
    """Rows of all partitions in four, behind a shuffle: a bare coalesce would make the parts in four tasks too."""
    return parts.repartition(4)


def fit(labelled: DataFrame, n_features: int = 256, gamma: float = 0.03, ridge: float = 1e-3, seed: int = 7) -> Model:
    """labelled: stats array<double>, label int, calibrate boolean. gamma: of exp(-gamma * |x - y|^2)."""
    d = N_STATISTICS

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros(d)
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["stats"].tolist())
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.tolist()]})

    def summed(arrays: str) -> F.Column:
        return F.array(*[F.sum(F.col(arrays)[i]) for i in range(d)]).alias(arrays)

    row = labelled.select("stats").mapInPandas(moments, "n long, s array<double>, q array<double>").agg(F.sum("n").alias("n"), summed("s"), summed("q")).first()
    if not row or not row["n"]:
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.array([0.5, 0.0]), (np.array([0.0, 1.0]), np.array([0.5, 0.5])))
    mean = np.array(row["s"]) / row["n"]
    scale = np.sqrt(np.maximum(np.array(row["q"]) / row["n"] - mean**2, 1e-12)).clip(1e-6)
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), (np.array([0.0]), np.array([0.5])))

    def normal_equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = n_features + 1
        gram, moment, seen = np.zeros((m, m)), np.zeros(m), 0
        for pdf in batches:
            if len(pdf):
                z = model.features(np.array(pdf["stats"].tolist()))
                gram, moment, seen = gram + z.T @ z, moment + z.T @ pdf["label"].to_numpy(float), seen + len(pdf)
        if seen:
            yield pd.DataFrame({"slot": [0], "n": [seen], "gram": [gram.tobytes()], "moment": [moment.tobytes()]})

    def add(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram, moment = 0, 0.0, 0.0
        for pdf in pdfs:
            for r in pdf.itertuples():
                n, gram, moment = n + r.n, gram + np.frombuffer(r.gram), moment + np.frombuffer(r.moment)
        if n:
            yield pd.DataFrame({"slot": [0], "n": [n], "gram": [gram.tobytes()], "moment": [moment.tobytes()]})

    schema = "slot int, n long, gram binary, moment binary"
    parts = labelled.filter(~F.col("calibrate")).select("stats", "label").mapInPandas(normal_equations, schema)
    sums = gathered(parts).mapInPandas(add, schema).collect()  # one matrix a partition, at most four to the driver
    if sums:
        m = n_features + 1
        gram = sum(np.frombuffer(r["gram"]).reshape(m, m) for r in sums)
        moment = sum(np.frombuffer(r["moment"]) for r in sums)
        n = sum(r["n"] for r in sums)
        penalty = ridge * n / m * np.eye(m)
        penalty[0, 0] = 0
        model.coefficients = np.linalg.solve(gram + penalty + 1e-9 * np.eye(m), moment)
    held = scored(labelled.filter("calibrate"), model, "raw", ["label"])
    model.knots = calibration(held, "raw", "label")
    return model


def scored(stats: DataFrame, model: Model, out: str, keep: list[str]) -> DataFrame:
    """Adds `out` (uncalibrated when it is called raw) to the columns `keep`."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # its size is fixed by n_features

    def score():
        m = shared.value

        def of(batch):
            raw = m.raw(np.array(batch.column("stats").to_pylist()))
            return [raw if out == "raw" else calibrated(raw, m.knots)]

        return of

    return computed(stats.select(*keep, "stats"), keep, {out: "double"}, score)


def learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, label of the label rows that may teach."""
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(learned_from("id", 4, 2))


def labelled_rows(stats: DataFrame, known: DataFrame) -> DataFrame:
    return stats.join(known, "id").withColumn("calibrate", F.pmod(F.xxhash64("id"), F.lit(5)) == 0).select("stats", "label", "calibrate")


def with_scores(docs: DataFrame, labels: DataFrame, score_col: str = "score", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with all its columns and the score of each row's text, in one pass over them: no row is looked up by
    its id. The model is that of score_documents(), from the labelled rows alone."""
    known = learnable(labels, id_col, label_col)
    taught = docs.select(id_col, text_col).join(known.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    model = fit(labelled_rows(stored(with_statistics(taught, id_col, text_col), "labelled-stats"), known))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by n_features

    def score():
        m = shared.value
        return lambda b: [calibrated(m.raw(np.array([statistics(t) for t in b.column(text_col).to_pylist()])), m.knots)]

    return computed(docs, docs.columns, {score_col: "double"}, score)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """id, held_out, score, predicted for every row of docs; and row_col, if given.

    Labels teach from rows whose crc32(id) mod 4 is not 2; of these, those whose xxhash64(id) mod 5 is 0
    calibrate and the others fit the ridge.
    """
    stats = stored(with_statistics(docs, id_col, text_col, row_col), "quality-stats")
    model = fit(labelled_rows(stats, learnable(labels, id_col, label_col)))
    return scored(stats, model, "score", ["id", "row"] if row_col else ["id"]).select(
        F.col("id").alias(id_col),
        (~learned_from("id", 4, 2)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
