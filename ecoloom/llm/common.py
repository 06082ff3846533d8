"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ecoloom.storage import release, shared_dir, stored  # noqa: F401  the operators take them from here

#: Words that one Python worker remembers the hash of; beyond it the memory is emptied and filled anew.
CACHED_WORDS = 200_000


#: Types of the columns that computed() adds.
ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def computed(df: DataFrame, keep: list[str], new: dict[str, str], start: Callable) -> DataFrame:
    """The columns `keep` of df as they are, and the columns `new` (name -> a type of ARROW).

    start() is called once a task; the function that it returns makes the new columns' values, in their
    order, from a batch of df. Kept columns never leave Arrow, so long ids beside nulls stay exact.
    """

    def run(batches):
        make = start()
        for b in batches:
            if b.num_rows:
                values = [pa.array(v, ARROW[t]) for v, t in zip(make(b), new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *values], names=[*keep, *new])

    fields = [df.schema[c] for c in keep] + StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in new.items())).fields
    return df.mapInArrow(run, StructType(fields))


def texts_of(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(df: DataFrame) -> tuple[DataFrame, str]:
    """df, stored, with a column that no two rows share, whatever their ids are; and that column's name."""
    row = fresh(df, "row")
    return stored(df.withColumn(row, F.monotonically_increasing_id()), "identified"), row


def learned_from(id_col: str, modulus: int, held_out: int) -> Column:
    """True where crc32 of the id's text leaves another remainder than held_out; null ids count as 0."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (crc % modulus) != held_out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. The built-in lower() is used where the text has no other upper-case letter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    others = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]"
    return F.when(text.rlike(others), F.translate(text, upper, lower)).otherwise(F.lower(text))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a column that a lambda uses may be put into it, and computed
    again for every element, whereas a lambda's own variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for up to CACHED_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the bytes 0x20 and 0x09-0x0D: the words [^\\x20\\x09-\\x0D]+."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (two multiply-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words; one of the whole sequence when it is shorter; none for no word."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mixed(out + h[j : j + n])
    return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x; returns knots (x, fitted y), y not falling."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            bx, by, bw = blocks.pop()
            ax, ay, aw = blocks[-1]
            blocks[-1] = [(ax * aw + bx * bw) / (aw + bw), (ay * aw + by * bw) / (aw + bw), aw + bw]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def calibration(scored: DataFrame, raw: str, label: str, bins: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic knots of P(label = 1 | raw) from per-bin counts; the driver sees at most `bins` rows.

    raw is clipped to [-1, 2]. With no rows the map is the identity on [0, 1].
    """
    lo, hi = -1.0, 2.0
    part = F.least(F.lit(bins - 1), F.floor((F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(raw))) - lo) / (hi - lo) * bins))
    rows = (
        scored.groupBy(part.alias("bin"))
        .agg(F.avg(raw).alias("x"), F.avg(F.col(label).cast("double")).alias("y"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()
    )
    if not rows:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return isotonic(*(np.array([float(r[c]) for r in rows]) for c in ("x", "y", "n")))


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Interpolates between the knots and leans a thousandth on raw, so that order is kept inside flat steps."""
    fit = np.interp(raw, *knots)
    return np.clip(0.999 * fit + 0.001 * np.clip(raw, 0, 1), 0, 1)
