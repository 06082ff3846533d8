"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every item gives its windows of `window` consecutive words (an item of fewer words is one window).
A window is the ordered set of its word shingles (three words, fewer in shorter windows). Documents'
shingles that occur in some window are found by one join; their counts order each window's shingles
by rarity. Containment asks for all shingles of a window, so its one rarest is the necessary prefix: a
window one of whose shingles no document has is given up at once, and the others meet documents at that
shingle only. The shingle's place in the window fixes where the window would start; starts before the
document or ends behind it are dropped (positional and length bound), and the rest is verified word by
word against the document.

Defined results: a null or empty text has no words and no hits; a null or wordless item no windows;
items with equal ids count as one item, and an item without id marks words but is not listed. Rows with
equal document ids are checked each against its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoloom.llm.common import ascii_lower, let, stored

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Shingles of all items that may be broadcast to the scan of the documents; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def shingles_of(words: Column, width: int) -> Column:
    """Hash of every run of `width` words, by position; empty where there are fewer words."""

    def all_of(w: Column) -> Column:
        last = F.size(w) - width
        at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)], F.lit(width))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))

    return let(words, all_of)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """items(item, text) -> key (the words joined), len, width, items, shingles; one row a distinct window."""
    w = items.select("item", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("w"))
    distinct = each.groupBy(F.array_join("w", " ").alias("key"), "w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sized = distinct.withColumn("len", F.size("w")).withColumn("width", F.least(F.lit(SHINGLE), F.size("w")))
    shingles = F.coalesce(*[F.when(F.col("width") == n, shingles_of(F.col("w"), n)) for n in range(1, SHINGLE + 1)])
    return sized.select("key", "len", "width", "items", shingles.alias("shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_hit, items (array of the items with occurring windows), spans
    (array of struct(start, len): each verified window, counted in words from 0)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    windows = stored(windows_of(items, window), "windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # 1, 2, 3 at most
    wanted = windows.select(F.explode("shingles").alias("h")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    worded = rows.select("id", words_of(F.col("text")).alias("words"))
    shingles = let(F.col("words"), lambda w: F.struct(F.size(w).alias("n"), *[shingles_of(w, k).alias(f"s{k}") for k in widths]))
    sized = worded.select("id", shingles.alias("x")).select("id", "x.*")
    found = None
    for w in widths:
        part = sized.select("id", "n", F.posexplode(f"s{w}").alias("pos", "h")).join(wanted, "h")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select("id", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).limit(0)
    found = stored(found, "found")

    counts = found.groupBy("h").agg(F.count("*").alias("df"))
    places = windows.select("key", "len", "items", F.posexplode("shingles").alias("offset", "h"))
    ranked = places.join(counts, "h", "left").groupBy("key", "len", "items").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "h")).alias("rarest"))
    prefix = ranked.filter("rarest.df > 0").select("key", "len", "items", "rarest.offset", "rarest.h")
    start = F.col("pos") - F.col("offset")
    met = found.join(prefix, "h").filter((start >= 0) & (start + F.col("len") <= F.col("n")))
    candidates = met.groupBy(F.col("id").alias("cid")).agg(F.collect_set(F.struct(start.alias("start"), "len", "key", "items")).alias("candidates"))

    joined = rows.join(candidates, F.col("id").eqNullSafe(F.col("cid")), "left").select("id", words_of(F.col("text")).alias("words"), "candidates")
    same = lambda w: F.filter("candidates", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ") == c["key"])
    checked = joined.select("id", let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), same(w).alias("hits"))).alias("x")).select("id", "x.*")
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1)))))
    listed = F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"])))
    spans = F.array_sort(F.transform("hits", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"))))
    none = F.col("hits").isNull()
    return checked.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(none, F.lit(0)).otherwise(hit).cast("long").alias("n_hit"),
        F.when(none, F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>")).otherwise(listed).alias("items"),
        F.when(none, F.array().cast("array<struct<start:int,len:int>>")).otherwise(spans).alias("spans"),
    )


def digest(checked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of decontaminate() with the items as a count and a SHA-256."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return checked.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
