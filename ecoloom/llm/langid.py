"""Language identification by rank-order n-gram profiles.

The n-grams of 1 to 3 letters (words padded by a blank on both sides, letters lower-cased) of a
document are ranked by frequency; the document's `top` first are compared to each language's profile by
the sum of the rank differences, an n-gram that the profile lacks costing the most. The language of the
least distance wins, the first by name among equals.

Profiles are fitted on a bounded sample of labelled rows: at most `max_documents` of them, those of the
least xxhash64(id). Scoring reads every whole text.

Defined results: a null text or one without letters is `und` with score 0; so is every text when no
labelled row is there to learn from. Equal counts are ranked by the n-gram's code points. A null lang
teaches nothing. Repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoloom.llm.common import computed, learned_from, texts_of

_BLANK = 32
_BITS = np.uint64(21)


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def ngrams(text: str | None) -> np.ndarray:
    """Every n-gram of 1 to 3 as a number; empty when the text has no letter."""
    if not text:
        return np.empty(0, np.uint64)
    if not _TABLE:
        _TABLE.append(_letters())
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _TABLE[0][codes]
    blank = x == _BLANK
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    x = x[keep].astype(np.uint64)
    if len(x) < 3:
        return np.empty(0, np.uint64)
    blank = x == _BLANK
    two = (x[:-1] << _BITS) | x[1:]
    three = (two[:-1] << _BITS) | x[2:]
    return np.concatenate([x[~blank], two, three[~blank[1:-1]]])


def ranked(grams: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent n-grams, most frequent first, equal ones by value."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:top]]


def fit(labelled: DataFrame, top: int = 400) -> dict[str, np.ndarray]:
    """labelled(text, lang) -> language: its ranked profile. n-grams are counted by partition, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                parts = [ngrams(t) for t in group["text"]]
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                if len(values):
                    yield pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": counts})

    counts = labelled.select("text", "lang").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.groupBy("lang").agg(F.expr(f"slice(array_sort(collect_list(struct(-n as c, gram))), 1, {int(top)}).gram").alias("grams"))
    return {r["lang"]: np.array(r["grams"], np.uint64) for r in best.collect()}


def identify(docs: DataFrame, max_documents: int = 20_000, top: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score for every row of docs; learns where crc32(id) mod 5 is not 0.

    score: 1 less the winner's distance as a share of the greatest possible, weighed against the next
    best: d2 / (d1 + d2) of the two least distances (1 for a single language with distance 0).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned_from("id", 5, 0))
    chosen = known.select(F.xxhash64("id").alias("h"), F.col("id").alias("chosen")).orderBy("h", "chosen").limit(max_documents).select("chosen").distinct()
    profiles = fit(known.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("chosen"))), top)
    languages = sorted(profiles)
    tables = []
    for name in languages:
        grams = profiles[name]
        order = np.argsort(grams)
        tables.append((grams[order], order.astype(np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # languages x top numbers

    def predict():
        def of(batch):
            preds, scores = [], []
            for text in texts_of(batch):
                grams = ranked(ngrams(text), top)
                if not len(grams) or not shared.value:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                ranks, distances = np.arange(len(grams)), []
                for values, positions in shared.value:
                    at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
                    out = np.where(values[at] == grams, np.abs(positions[at] - ranks), top)
                    distances.append(int(out.sum()))
                best = int(np.argmin(distances))
                first = distances[best]
                second = min((d for i, d in enumerate(distances) if i != best), default=top * len(grams))
                preds.append(languages[best])
                scores.append(second / (first + second) if first + second else 0.5)
            return preds, scores

        return of

    scored = computed(rows.select("id", "text"), ["id"], {"lang_pred": "string", "score": "double"}, predict)
    return scored.select(F.col("id").alias(id_col), (~learned_from("id", 5, 0)).alias("held_out"), "lang_pred", "score")
