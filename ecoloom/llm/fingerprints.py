"""SimHash fingerprints and a search by permuted block tables.

The terms of a text (words and pairs of neighbouring words, and for short texts runs of three
characters) are hashed to 128 bits; each votes on every bit with its weight, 1 + ln(count), and the
sign of the sum is the bit. The share of equal bits estimates the angle between term vectors, so
`likeness` is the cosine of that angle, not below 0.

Defined results: a null text counts as empty; the fingerprint of a text without terms is all zero bits.
Equal texts have equal fingerprints. Rows without id come last in the order of rows; rows of equal ids, or
of none, stand in the order of a hash of their text. Ids may be of any type that has an order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ecoloom.llm.common import WordHashes, computed, hashes_of, mixed, stored, texts_of, words_of

BITS = 128
SHORT = 24  # texts of fewer words also give their runs of three characters


def terms(text: str, known: WordHashes) -> np.ndarray:
    words = words_of(text)
    h = hashes_of(words, known)
    parts = [h, mixed(h[:-1] * np.uint64(3) + h[1:])]
    if len(words) < SHORT:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        parts.append(mixed((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]))
    return np.concatenate(parts)


def fingerprint(text: str | None, known: WordHashes) -> bytes:
    """16 bytes."""
    if not text:
        return bytes(BITS // 8)
    values, counts = np.unique(terms(text, known), return_counts=True)
    if not len(values):
        return bytes(BITS // 8)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for start in range(0, len(values), 8192):
        part = values[start : start + 8192]
        both = np.stack([part, mixed(part + np.uint64(0x9E3779B97F4A7C15))], 1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(part), 16), axis=1)
        w = weights[start : start + 8192]
        votes += 2 * (w @ bits.astype(np.float32)) - w.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(one: bytes, two: bytes) -> float:
    """Cosine of the angle that the differing bits stand for; 1 for equal, 0 for 90 degrees and more."""
    apart = (int.from_bytes(one) ^ int.from_bytes(two)).bit_count()
    return float(max(0.0, np.cos(np.pi * apart / BITS)))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (32 hex digits) for every row."""

    def make():
        known = WordHashes()
        return lambda batch: [[fingerprint(t, known).hex() for t in texts_of(batch)]]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return computed(rows, ["id"], {"fingerprint": "string"}, make).withColumnRenamed("id", id_col)


def _half(fp: Column, n: int) -> Column:
    """Hex digits 16n+1 ... 16n+16 as a long, bit for bit."""
    digits = F.substring(fp, 16 * n + 1, 16)
    high, low = (F.conv(F.substring(digits, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def distance(one: Column, two: Column) -> Column:
    """Differing bits of two fingerprints in hex."""
    return F.bit_count(_half(one, 0).bitwiseXOR(_half(two, 0))) + F.bit_count(_half(one, 1).bitwiseXOR(_half(two, 1)))


def blocks_of(high: Column, low: Column, per_half: int) -> list[tuple[Column, int]]:
    """(content as a long, width in bits) of the blocks that the two halves are cut into."""
    cuts = [round(64 * i / per_half) for i in range(per_half + 1)]
    widths = [(b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(F.shiftrightunsigned(half, 64 - end).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)), width) for half in (high, low) for end, width in widths]


def search(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, flips: int = 0) -> DataFrame:
    """query, fingerprint, distance: all distinct fingerprints within `radius` bits of each distinct query.

    The bits are cut into blocks, so many that two fingerprints within the radius differ in at most `flips` bits
    of one block at least. Every block leads one table, keyed by the block's number and content, and a query
    asks each table for its own content with every choice of up to `flips` bits turned over: more flips, longer
    keys and more questions. Equal fingerprints are one entry, so copies do not multiply; entries are met at
    their first such block only.
    """
    per_half = -(-(radius // (flips + 1) + 1) // 2)
    if per_half > 32:
        raise ValueError("radius is too wide for these flips: blocks have two bits at least")

    def halves(df: DataFrame, name: str) -> DataFrame:
        prints = df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct()
        return prints.select(_half(F.col(name), 0).alias(f"{name}_high"), _half(F.col(name), 1).alias(f"{name}_low"))

    def asked(block: int, content: Column):
        return lambda mask: F.struct(F.lit(block).alias("block"), content.bitwiseXOR(mask).alias("key"))

    def keys(name: str, masks: bool) -> Column:
        each = []
        for i, (content, width) in enumerate(blocks_of(F.col(f"{name}_high"), F.col(f"{name}_low"), per_half)):
            turned = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)] if masks else [0]
            signed = [m - (1 << 64) if m >> 63 else m for m in turned]
            each.append(F.transform(F.lit(signed).cast("array<long>"), asked(i, content)))
        return F.explode(F.flatten(F.array(*each))).alias("at")

    q = halves(queries, "query").select("*", keys("query", True)).select("*", "at.*").drop("at")
    t = halves(fingerprints, "fingerprint").select("*", keys("fingerprint", False)).select("*", "at.*").drop("at")
    high, low = F.col("query_high").bitwiseXOR(F.col("fingerprint_high")), F.col("query_low").bitwiseXOR(F.col("fingerprint_low"))
    far = F.bit_count(high) + F.bit_count(low)
    first = F.coalesce(*[F.when(F.bit_count(c) <= flips, F.lit(i)) for i, (c, _) in enumerate(blocks_of(high, low, per_half))])
    # a query asks many times, so its side is never broadcast, however small the queries are
    met = q.hint("merge").join(t, ["block", "key"]).filter((far <= radius) & (F.col("block") == first))
    shown = lambda name: F.lower(F.concat(*[F.lpad(F.hex(f"{name}_{half}"), 16, "0") for half in ("high", "low")])).alias(name)
    return met.select(shown("query"), shown("fingerprint"), far.alias("distance"))


def with_matches(rows: DataFrame, radius: int = 23, flips: int = 2, divisor: int = 100, longest: int = 100_000, id_col: str = "doc_id") -> DataFrame:
    """rows(id, fingerprint, ...) with part and matches: for ids divisible by `divisor` (the queries), every
    fingerprint within `radius` bits of the row's own, itself included, nearest first: (distance,
    fingerprint, first_id, copies); null for the others.

    A fingerprint stands for the class of its copies: `copies` rows, the least id of which is first_id;
    the rows that have it in the column fingerprint are its members. A query has one row, numbered part 0; only
    one of more than `longest` matches has several.

    23 bits reach copies of 0.8 (Jaccard on five words; see the README for shares); unrelated texts lie at 42
    bits and more. With 2 flips the blocks have 16 bits.
    """
    classes = rows.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    classes = stored(classes, "fingerprint-classes")
    asks = F.col(id_col) % divisor == 0
    found = stored(search(rows.filter(asks), classes, radius, flips), "fingerprint-matches")
    sizes = found.groupBy(F.col("query").alias("q")).agg(F.count("*").alias("n"))
    parts = found.join(sizes, F.col("query") == F.col("q")).withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("n") / longest)).cast("int"))
    named = parts.join(classes, "fingerprint").groupBy("query", "part").agg(F.array_sort(F.collect_list(F.struct("distance", "fingerprint", "first_id", "copies"))).alias("matches"))
    return rows.join(named, (F.col("fingerprint") == F.col("query")) & asks, "left").drop("query")


def rank_of(i: object, h: int) -> tuple:
    """Sorts as the rows do, last row first: none, then ids ascending."""
    return i is not None, i, h


def ranges_of(keys: DataFrame, parts: int) -> list[tuple]:
    """keys(id, h) -> the least and the greatest rank of each range, ascending, as Spark's range partitioner cuts
    them; at most `parts` of them come to the driver."""
    one = F.struct(F.col("id").isNotNull().alias("some"), "id", "h")
    cut = keys.repartitionByRange(parts, F.col("id").asc_nulls_first(), "h").groupBy(F.spark_partition_id().alias("part"))
    return sorted((tuple(r["low"]), tuple(r["high"])) for r in cut.agg(F.min(one).alias("low"), F.max(one).alias("high")).collect())


def edited_neighbours(docs: DataFrame, part_bytes: int = 8_000_000, most_parts: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row, in descending id (nulls last): its fingerprint, that of the text whose last third is
    replaced by the next row's beginning, and the likeness to both that and the next row's fingerprint.

    Rows are cut into ranges of (id, hash of text) of about part_bytes; the first row of the next range is
    added to each, so every range is worked through by itself, in order and row by row, without being held.
    Of most_parts ranges on they get longer (a gigabyte each at 100 TB).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n_bytes = int(rows.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0)
    parts = max(1, min(most_parts, n_bytes // part_bytes))
    ranges = ranges_of(rows.select("id", "h"), parts)
    heads = spark.sparkContext.broadcast(([low for low, _ in ranges], [high for _, high in ranges]))

    @F.arrow_udf("array<int>")
    def keys_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        lows, highs = heads.value
        out = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
            rank = rank_of(i, h)
            p = bisect_right(lows, rank) - 1
            out.append([2 * p, 2 * ((p + 1) % len(lows)) + 1] if rank == highs[p] else [2 * p])
        return pa.array(out, pa.list_(pa.int32()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held = None  # (key, id, text, fingerprint) of the row that waits for its next
        for batch in batches:
            out = []
            for key, i, text in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "text")), strict=True):
                # a waiting row takes the next of its range; the first added row closes the range
                if held is not None and held[0] // 2 == key // 2:
                    fp = fingerprint(text, known)
                    out.append(compared(held, text, fp, known))
                    held = (key, i, text, fp) if key % 2 == 0 else None
                else:
                    held = (key, i, text, fingerprint(text, known)) if key % 2 == 0 else None
            if out:
                types = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", *new.names])

    def compared(row: tuple, next_text: str, next_fp: bytes, known: WordHashes) -> tuple:
        _, i, text, fp = row
        third = len(text) // 3
        edited = text[: len(text) - third] + next_text[:third]
        efp = fingerprint(edited, known)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return i, len(text), sha, fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, next_fp)

    new = StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    dealt = rows.withColumn("key", F.explode(keys_of("id", "h"))).withColumn("range", F.floor(F.col("key") / 2))
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", F.col("key") % 2, F.col("id").desc_nulls_last(), F.desc("h"))
    done = ordered.select("key", "id", "text").mapInArrow(walk, StructType([rows.schema["id"], *new.fields]))
    return done.withColumnRenamed("id", id_col)
