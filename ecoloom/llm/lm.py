"""Language-model scoring by deleted interpolation of word n-grams.

P(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), the weights chosen by the frequency bucket of
the context v. Weights are learnt by expectation-maximisation on held-out counts: a tenth of the
training documents is taken out of all counts ("deleted"), and its tokens are predicted from the rest.
The final scores use the counts of all training documents. The sequence is the words and one end; the
context of the first token is a start.

Counts are not joined to documents row by row. Documents are cut into units, as they lie in the input,
and stored with the unit's number. Every unit asks once for each of its distinct unigrams and bigrams, with
its own counts; the asked keys are dealt by hash range to buckets that sum them over all units and answer
every unit in key order, so an answer needs no keys. A key that a third of all documents use is asked once by
each unit, like any other, and a unit's answer is as large as its own text. Units and buckets both grow with
the square root of the corpus, so that the messages between them grow in proportion to it; from MOST_UNIT on
units stay as they are, and messages get smaller, down to one key.

Defined results: a null or empty text is the end alone. Rows with equal ids are separate documents; ids may
be of any type. With nothing to learn from, N = V = 0 and every token has probability 1.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ecoloom.llm.common import WordHashes, computed, hashes_of, learned_from, mixed, stored, texts_of, words_of

#: Hashes of the end token and of the start context; no word hashes to exactly these but by accident of 2^-64.
END, START = np.uint64(0x8E5D1C3A97F04B26), np.uint64(0x1B7F3E9D5C82A640)
#: Bytes of text of a unit: UNIT_ROOT times the root of all bytes, between these two. A worker holds one unit.
UNIT_ROOT, LEAST_UNIT, MOST_UNIT = 100, 200_000, 24_000_000
#: Bytes of text that a task works through, about.
TASK_BYTES = 16_000_000
STEP = 0.05  # of log10 in the histogram that expectation-maximisation works on


def tokens(text: str | None, known: WordHashes) -> np.ndarray:
    return np.append(hashes_of(words_of(text), known), END)


def bigrams(unigrams: np.ndarray) -> np.ndarray:
    before = np.empty_like(unigrams)
    before[0], before[1:] = START, unigrams[:-1]
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + unigrams)


def in_units(rows: DataFrame, unit_bytes: int) -> DataFrame:
    """rows(text, deleted, ...), stored with `unit`: runs of rows of about unit_bytes, deleted ones (odd numbers)
    and others (even numbers) apart."""

    def cut():
        task, filled = TaskContext.get().partitionId(), 0

        def of(batch):
            nonlocal filled
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
            ends = filled + np.cumsum(sizes)
            filled = int(ends[-1])
            run = (task << 32) + (ends - sizes) // unit_bytes
            return [2 * run + batch.column("deleted").to_numpy(zero_copy_only=False)]

        return of

    return stored(computed(rows, rows.columns, {"unit": "long"}, cut), "lm-units")


def asked(docs: DataFrame, n_buckets: int) -> DataFrame:
    """docs(unit, train, text) -> kind, bucket, units, sizes, keys, counts: packed requests."""
    edges = np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], np.uint64)

    def pack(held: dict) -> pd.DataFrame:
        slots: dict[tuple[int, int], list] = defaultdict(list)
        for (unit, train), parts in held.items():
            for kind in (1, 2):
                keys, counts = np.unique(np.concatenate([p[kind - 1] for p in parts]), return_counts=True)
                counts = counts.astype(np.uint32) if train else np.zeros(len(keys), np.uint32)
                bucket = np.searchsorted(edges, keys, side="right")
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                    slots[kind, int(bucket[lo])].append((unit, keys[lo:hi], counts[lo:hi]))
        rows = []
        for (kind, b), parts in slots.items():
            units, sizes = np.array([p[0] for p in parts], np.int64), np.array([len(p[1]) for p in parts], np.int32)
            rows.append((kind, b, units.tobytes(), sizes.tobytes(), np.concatenate([p[1] for p in parts]).tobytes(), np.concatenate([p[2] for p in parts]).tobytes()))
        return pd.DataFrame(rows, columns=["kind", "bucket", "units", "sizes", "keys", "counts"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, run = WordHashes(), defaultdict(list), None
        for pdf in batches:
            for unit, train, text in zip(pdf["unit"].tolist(), pdf["train"].tolist(), pdf["text"], strict=True):
                if unit // 2 != run:
                    if held:
                        yield pack(held)
                    held, run = defaultdict(list), unit // 2
                one = tokens(text, known)
                held[unit, train].append((one, bigrams(one)))
        if held:
            yield pack(held)

    return docs.select("unit", "train", "text").mapInPandas(ask, "kind int, bucket int, units binary, sizes binary, keys binary, counts binary")


def answered(requests: DataFrame, parts: int) -> DataFrame:
    """unit, kind, bucket, totals, deleted: for a unit's sorted distinct keys of the bucket, the counts over
    all training documents and over the deleted ones (units with odd numbers). Unit -1 has, in totals, the
    bucket's distinct keys with a count, the sum of counts, and the sum of deleted counts."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        units = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["units"]])
        sizes = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
        of = np.repeat(units, sizes)
        order = np.argsort(keys)
        k = keys[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        distinct = k[new]
        total = np.add.reduceat(counts[order], new)
        deleted = np.add.reduceat((counts * (of % 2))[order], new)
        rows = [(-1, kind, bucket, np.array([(total > 0).sum(), total.sum(), deleted.sum()], np.int64).tobytes(), b"")]
        ends = np.cumsum(sizes)
        parts = defaultdict(list)
        for unit, size, end in zip(units.tolist(), sizes.tolist(), ends.tolist(), strict=True):
            parts[unit].append(keys[end - size : end])
        for unit, own in parts.items():
            at = np.searchsorted(distinct, own[0] if len(own) == 1 else np.unique(np.concatenate(own)))
            rows.append((unit, kind, bucket, total[at].tobytes(), deleted[at].astype(np.int64).tobytes() if unit % 2 else b""))
        return pd.DataFrame([(u, n, b, _packed(t), _packed(d)) if u >= 0 else (u, n, b, t, d) for u, n, b, t, d in rows], columns=["unit", "kind", "bucket", "totals", "deleted"])

    dealt = requests.repartition(parts, "kind", "bucket").groupBy("kind", "bucket")
    return dealt.applyInPandas(answer, "unit long, kind int, bucket int, totals binary, deleted binary")


def _packed(longs: bytes) -> bytes:
    """Counts as bytes; those above 254 follow as longs."""
    x = np.frombuffer(longs, np.int64)
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(data[n:], np.int64)
    return x


class Unit:
    """Tokens of a unit's documents, with the counts that its answers give."""

    def __init__(self, docs: pa.Table, answers: pa.Table, n_buckets: int):
        known, answers = WordHashes(), answers.to_pandas()
        lists = [tokens(t, known) for t in texts_of(docs)]
        self.lengths = np.array([len(x) for x in lists])
        self.starts = np.append(0, np.cumsum(self.lengths)[:-1])
        one = np.concatenate(lists)
        two = np.concatenate([bigrams(x) for x in lists])
        edges = np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], np.uint64)
        self.c, self.c_deleted = self.looked_up(one, answers[answers["kind"] == 1], edges)
        self.pair, self.pair_deleted = self.looked_up(two, answers[answers["kind"] == 2], edges)
        self.is_first = np.zeros(len(one), bool)
        self.is_first[self.starts] = True

    @staticmethod
    def looked_up(keys: np.ndarray, answers: pd.DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(keys, return_inverse=True)
        cuts = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
        total, deleted = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for bucket, t, d in zip(answers["bucket"], answers["totals"], answers["deleted"], strict=True):
            lo, hi = cuts[bucket], cuts[bucket + 1]
            total[lo:hi] = _unpacked(t, hi - lo)
            if len(d):
                deleted[lo:hi] = _unpacked(d, hi - lo)
        return total[at], deleted[at]

    def contexts(self, c: np.ndarray) -> np.ndarray:
        """Count of each token's context; the start occurs as often as the end."""
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[self.is_first] = c[self.starts + self.lengths - 1]
        return before


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Frequency bucket: 0 for an unseen context, else 1 + floor(log2 count), 31 at most."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).clip(0, 31).astype(np.int64)


def ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.where(a > 0, a / np.maximum(b, 1), 0.0)


def learnt_weights(histogram: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """(32, 3) weights of bigram, unigram and uniform by bucket; histogram(bucket, two, one, n) in steps of log10."""
    weights = np.tile([0.0, 0.97, 0.03], (32, 1))
    for b, rows in histogram.groupby("bucket"):
        p = np.stack([np.where(rows[c] > -9000, 10.0 ** (rows[c] * STEP), 0.0) for c in ("two", "one")] + [np.full(len(rows), uniform)], 1)
        n, w = rows["n"].to_numpy(float), np.array([0.4, 0.55, 0.05])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = np.maximum((share * n[:, None]).sum(0) / n.sum(), [0, 0, 1e-4])
            w /= w.sum()
        weights[int(b)] = w
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from rows whose crc32(id) mod 10 is not 0; those of them whose xxhash64(id, text) mod 10 is 0 are
    the deleted ones.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    train = learned_from(id_col, 10, 0)
    deleted = train & (F.pmod(F.xxhash64(F.col(id_col), text), F.lit(10)) == 0)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), train.alias("train"), deleted.alias("deleted"))
    n_bytes = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    unit_bytes = int(min(max(UNIT_ROOT * math.sqrt(n_bytes), LEAST_UNIT), MOST_UNIT))
    n_buckets = max(1, n_bytes // unit_bytes)
    parts = max(1, n_bytes // TASK_BYTES, min(n_buckets, spark.sparkContext.defaultParallelism))
    placed = in_units(rows, unit_bytes)
    answers = stored(answered(asked(placed, n_buckets), parts), "lm-answers")
    stats = [np.frombuffer(r["totals"], np.int64) for r in answers.filter("unit = -1 and kind = 1").select("totals").collect()]  # a row a bucket
    vocabulary, total, total_deleted = (int(sum(s[i] for s in stats)) for i in range(3))
    uniform = 1 / (vocabulary + 1)
    own = answers.filter("unit >= 0").select("unit", "kind", "bucket", "totals", "deleted")

    def histogram(unit_docs: pa.Table, unit_answers: pa.Table) -> pa.Table:
        names = ["bucket", "two", "one", "n"]
        if not unit_docs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        u = Unit(unit_docs, unit_answers, n_buckets)
        context = u.contexts(u.c - u.c_deleted)
        p2 = ratio(u.pair - u.pair_deleted, context)
        p1 = ratio(u.c - u.c_deleted, total - total_deleted)
        step = lambda p: np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300)) / STEP), -9999).astype(np.int64) + 10_000
        cells, n = np.unique((bucket_of(context) << 32) | (step(p2) << 16) | step(p1), return_counts=True)
        return pa.table(dict(zip(names, (cells >> 32, ((cells >> 16) & 0xFFFF) - 10_000, (cells & 0xFFFF) - 10_000, n), strict=True)))

    def by_unit(df: DataFrame):
        return df.repartition(parts, "unit").groupBy("unit")

    held = by_unit(placed.filter("deleted").select("unit", "text")).cogroup(by_unit(own.filter("unit % 2 = 1")))
    cells = held.applyInArrow(histogram, "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = learnt_weights(cells.toPandas(), uniform)  # cells are bounded by STEP, whatever the corpus
    shared = spark.sparkContext.broadcast(weights)

    def score(unit_docs: pa.Table, unit_answers: pa.Table) -> pa.Table:
        n_tokens, n_known, bases, models = ([], [], [], [])
        if unit_docs.num_rows:
            u, w = Unit(unit_docs, unit_answers, n_buckets), shared.value
            context = u.contexts(u.c)
            mix = w[bucket_of(context)]
            p = mix[:, 0] * ratio(u.pair, context) + mix[:, 1] * ratio(u.c, total) + mix[:, 2] * uniform
            base = np.log10((u.c + 0.1) / (total + 0.1 * (vocabulary + 1))) if total else np.zeros(len(u.c))
            model = np.log10(p) if total else np.zeros(len(u.c))
            by = lambda x: np.add.reduceat(x, u.starts)
            n_tokens, n_known, bases, models = u.lengths, by((u.c > 0).astype(np.int64)), by(base), by(model)
        new = {"n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(models, pa.float64())}
        return pa.table({"id": unit_docs.column("id")} | new)

    every = by_unit(placed.select("unit", "id", "text")).cogroup(by_unit(own))
    fields = [placed.schema["id"], *StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields]
    scored = every.applyInArrow(score, StructType(fields))
    return scored.select(F.col("id").alias(id_col), (~learned_from("id", 10, 0)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
