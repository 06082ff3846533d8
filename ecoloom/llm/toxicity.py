"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their prefixes of 5 and 7 characters (toxic stems carry free endings in some
languages), and "the term occurs twice at least" and "three times at least" are terms of their own. From a
bounded sample of labelled rows every term is kept that a chi-square test ties to the label, at 5 % over all
terms tested (Bonferroni); documents are compared by TF-IDF over these. The examples stand in blocks; for every term the
index keeps each block's postings and its greatest weight. Blocks are visited in the order of their
upper bounds until the bound is at or below the k-th best similarity, so the neighbours are exact.

Neighbours vote with weight 1 / (distance + epsilon), distance = 1 - cosine; the share of toxic votes,
scaled by the best cosine, is calibrated isotonically on labelled rows that are not in the index.

Defined results: a null or empty text, or one without a kept term, has no neighbour, raw vote 0 and no
evidence. Equal similarities are ordered by example id. Without labels every score is 0.5. Repeated
label rows count as often as they stand; labels that are null or without a document teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoloom.llm.common import CACHED_WORDS, calibrated, calibration, computed, learned_from, stored, texts_of

_WORD = re.compile(r"\w+")
PREFIXES = (5, 7)
#: Tasks that the bounded sample is dealt to.
SAMPLE_TASKS = 8
#: A term's counts from which it stands for a further term.
REPEATS = (1, 2, 3)
BLOCK = 64


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def name_of(term: str, repeat: int) -> str:
    return term if repeat == 1 else f"{term} x{repeat}"


class TermIds(dict):
    """word -> its terms that are kept in some form, remembered for up to CACHED_WORDS words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.forms: dict[str, list[tuple[int, int]]] = {}
        for name, number in vocabulary.items():
            term, _, repeat = name.partition(" x")
            self.forms.setdefault(term, []).append((int(repeat or 1), number))

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = tuple(t for t in terms_of(word) if t in self.forms)
        return value


def term_counts(text: str | None, ids: TermIds) -> tuple[tuple[int, int], ...]:
    """(term, count) pairs of kept terms, in the order of their numbers."""
    counts: Counter[str] = Counter()
    for found in map(ids.__getitem__, words_of(text)):
        if found:
            counts.update(found)
    return tuple(sorted((number, n) for term, n in counts.items() for repeat, number in ids.forms[term] if n >= repeat))


@dataclass
class Index:
    vocabulary: dict[str, int]
    idf: np.ndarray
    example_ids: list
    labels: np.ndarray
    starts: np.ndarray  # (terms, blocks + 1): where a term's postings of a block begin
    docs: np.ndarray  # example number of each posting
    weights: np.ndarray
    block_max: np.ndarray  # (terms, blocks)

    @classmethod
    def build(cls, vocabulary: dict[str, int], examples: list[tuple]) -> Index:
        """examples: (id, label, ((term, count), ...)); those without a term have no vector and are left out."""
        examples = sorted((e for e in examples if e[2]), key=lambda e: e[0])
        df = np.zeros(len(vocabulary))
        for _, _, counts in examples:
            df[[t for t, _ in counts]] += 1
        idf = np.log((1 + len(examples)) / (1 + df)) + 1
        rows = []
        for number, (_, _, counts) in enumerate(examples):
            t = np.array([c[0] for c in counts])
            w = (1 + np.log([c[1] for c in counts])) * idf[t]
            rows += zip(t.tolist(), [number] * len(t), (w / np.linalg.norm(w)).tolist(), strict=True)
        rows.sort()
        blocks = max(1, -(-len(examples) // BLOCK))
        term = np.array([r[0] for r in rows], int)
        doc = np.array([r[1] for r in rows], int)
        weight = np.array([r[2] for r in rows], float)
        key = term * blocks + doc // BLOCK
        flat = np.searchsorted(key, np.arange(len(vocabulary) * blocks + 1))
        starts = np.stack([flat[i : i + blocks + 1] for i in range(0, len(vocabulary) * blocks, blocks)]) if len(vocabulary) else np.zeros((0, blocks + 1), int)
        block_max = np.zeros((len(vocabulary), blocks))
        np.maximum.at(block_max, (term, doc // BLOCK), weight)
        return cls(vocabulary, idf, [e[0] for e in examples], np.array([e[1] for e in examples], float), starts, doc, weight, block_max)

    def nearest(self, counts: tuple[tuple[int, int], ...], k: int, skip: object = None) -> list[tuple[float, int]]:
        """The k examples of greatest cosine above 0 as (cosine, example number), best first."""
        if not counts or not self.example_ids:
            return []
        t = [c[0] for c in counts]
        q = (1 + np.log([c[1] for c in counts])) * self.idf[t]
        q = q / np.linalg.norm(q)
        bounds = q @ self.block_max[t]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for weight, term in zip(q, t, strict=True):
                lo, hi = self.starts[term, b], self.starts[term, b + 1]
                if lo < hi:
                    scores[self.docs[lo:hi] - b * BLOCK] += weight * self.weights[lo:hi]
            found = np.flatnonzero(scores > 0)
            best += [(min(1.0, float(scores[i])), int(b * BLOCK + i)) for i in found if skip is None or self.example_ids[b * BLOCK + i] != skip]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return 0.0
        w = np.array([1 / (1 - s + 0.05) for s, _ in near])
        y = self.labels[[i for _, i in near]]
        return float(near[0][0] * (w @ y) / w.sum())


def kept_terms(examples: DataFrame, significance: float) -> list[str]:
    """The terms tied to the label by a chi-square test over documents, best first; `significance` holds for all
    terms together. Equal texts of one label count once, so a group of copies makes no term significant.

    Of terms that are each other's prefix and stand in as many documents, the longest is kept. The sample is
    bounded, and with it the number of its terms.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                rows[label] += 1
                counts = Counter(t for w in words_of(text) for t in terms_of(w))
                seen[label].update(name_of(t, r) for t, n in counts.items() for r in REPEATS if n >= r)
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"term": ["", *names], "n0": [rows[0], *(seen[0][t] for t in names)], "n1": [rows[1], *(seen[1][t] for t in names)]})

    sums = examples.select("text", "label").distinct().mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 > 2 or term = ''")
    sums = stored(sums, "toxicity-terms")
    total = sums.filter("term = ''").first()
    if not total or not total["n0"] or not total["n1"]:
        return []
    a, b, n0, n1 = F.col("n1"), F.col("n0"), F.lit(float(total["n0"])), F.lit(float(total["n1"]))
    n = n0 + n1
    odds = a * (n0 - b) - b * (n1 - a)
    chi2 = n * odds * odds / ((a + b) * (n - a - b + 1e-9) * n0 * n1)
    least = NormalDist().inv_cdf(1 - significance / max(1, sums.count() - 1) / 2) ** 2
    best = sums.filter("term != ''").withColumn("chi2", chi2).filter(F.col("chi2") >= least).orderBy(F.desc("chi2"), F.length("term").desc(), "term").collect()
    kept: list[str] = []
    stems: dict[tuple, list[str]] = {}
    for r in best:
        term, _, repeat = r["term"].partition(" x")
        longer = stems.setdefault((r["n0"], r["n1"], repeat), [])
        if not any(w.startswith(term.rstrip("*")) for w in longer):
            kept.append(r["term"])
            longer.append(term)
    return kept


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    k: int = 9,
    max_labelled: int = 8_000,
    max_examples: int = 3_000,
    significance: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """id, held_out, score, predicted, evidence (ids of the nearest examples) for every row of docs.

    Learns from at most max_labelled labelled rows whose crc32(id) mod 4 is not 2, those of the least
    xxhash64(id); the first max_examples of them with a kept term make the index and the others calibrate.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("known"), F.col(label_col).cast("int").alias("label")).filter("known is not null and label in (0, 1)").filter(learned_from("known", 4, 2))
    chosen = known.withColumn("h", F.xxhash64("known")).orderBy("h", "known", "label").limit(max_labelled)
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("known"))  # max_labelled rows of numbers
    sample = sample.orderBy("h", "id", "label", F.xxhash64("text")).limit(max_labelled)  # an id may stand in many rows
    sample = stored(sample.select("id", "text", "label", "h").repartition(SAMPLE_TASKS), "toxicity-sample")
    vocabulary = {t: i for i, t in enumerate(kept_terms(sample, significance))}
    words = spark.sparkContext.broadcast(vocabulary)

    def vectors():
        ids = TermIds(words.value)

        def of(batch):
            counts = [term_counts(t, ids) for t in texts_of(batch)]
            return [[t for t, _ in c] for c in counts], [[n for _, n in c] for c in counts]

        return of

    id_type = docs.schema[id_col].dataType.simpleString()
    learnt = computed(sample, ["id", "label", "h"], {"terms": "array<int>", "counts": "array<int>"}, vectors).orderBy("h", "id", "label", "terms", "counts").collect()  # max_labelled short vectors
    vectors_of = [(r["id"], r["label"], tuple(zip(r["terms"], r["counts"], strict=True))) for r in learnt]
    with_terms = [i for i, v in enumerate(vectors_of) if v[2]]
    cut = with_terms[min(max_examples, (2 * len(with_terms) + 2) // 3) - 1] + 1 if with_terms else 0
    index = Index.build(vocabulary, vectors_of[:cut])
    rest = vectors_of[cut:] or vectors_of
    raw = [(float(index.vote(index.nearest(c, k, i))), int(y)) for i, y, c in rest]
    knots = calibration(spark.createDataFrame(raw, "raw double, label int"), "raw", "label") if raw else (np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    model = spark.sparkContext.broadcast((index, knots))  # bounded by max_labelled texts' terms and max_examples

    def score():
        idx, fitted = model.value
        ids, found = TermIds(idx.vocabulary), {}

        def of(batch):
            votes, evidence = [], []
            for text in texts_of(batch):
                counts = term_counts(text, ids)
                if counts not in found:
                    if len(found) >= 50_000:
                        found.clear()
                    near = idx.nearest(counts, k)
                    found[counts] = idx.vote(near), [str(idx.example_ids[i]) for _, i in near]
                vote, ids_near = found[counts]
                votes.append(vote)
                evidence.append(ids_near)
            return calibrated(np.array(votes, float), fitted), evidence

        return of

    return computed(rows, ["id"], {"score": "double", "evidence": "array<string>"}, score).select(
        F.col("id").alias(id_col),
        (~learned_from("id", 4, 2)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.col("evidence").cast(f"array<{id_type}>").alias("evidence"),
    )
