"""Mixing sources to target weights along a time-varying curriculum.

A budget of words is shared among sources by weight; no source gets more than `repeat` times its size,
the excess going to the others by weight. Every source has a weight that changes linearly over training
time; its integral says what share of the source's words is due by then. A document copy that starts at
a given point of the source's cumulative demand is placed where that integral reaches the point, so
sorting by position gives the order of training.

Within a source documents stand in the order of md5(id) (of a hash of the text where the id is null), id,
a hash of the text. The running sum is
taken in two levels (buckets of about BUCKET_ROWS by the hash's first digits, then inside a bucket), so a
source with a third of all rows is still spread over many tasks. The last document is taken in part, so
each source meets its target to the word.

Defined results: a null text has size 0; null is a source of its own, last; rows with equal ids are
mixed as separate rows, and only rows equal in id and text are interchangeable, so reruns agree whatever
order the rows come in. A document of which nothing is taken has no copies. Ids may be of any type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a bucket, about.
BUCKET_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """sizes(source, source_size, ...) -> the same with weight, rank, target; one row a source.

    Sources reach their cap in the order of cap / weight. The first k are capped when the level
    (budget - their caps) / (weight of the others) is still at or above the k-th ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # sources only, never documents
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeat))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level before the first source that stays below its cap holds for it and for all after it
    tried = ranked.withColumn("level", level).withColumn("below", F.col("level") < F.col("ratio"))
    held = F.min(F.when(F.col("below"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    return tried.withColumn("held", held).withColumn("target", F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("held") * F.col("weight")))).select(*sizes.columns, "rank", "weight", "target")


def position(share: Column, start: Column, end: Column) -> Column:
    """Time t in [0, 1] at which the integral of the weight start + (end - start) t has reached `share` of its whole."""
    half = (end - start) / 2
    area = share * (start + half)
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * half * area))
    return F.when(share <= 0, F.lit(0.0)).when(share >= 1, F.lit(1.0)).otherwise(F.when(F.abs(half) < 1e-12, share).otherwise(2 * area / (start + root)))


def mix(
    docs: DataFrame,
    weights: list[float] = (3.0, 1.0, 2.0),
    schedules: list[tuple[float, float]] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)),
    share: float = 1.5,
    repeat: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole_rows: bool = False,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, copies; with whole_rows, the columns of
    docs in a struct `own` too.

    copies: array of (copy, words, position), one for each pass over the source that takes some of the
    document. weights and schedules (weight at the start and at the end of training) go to the sources in
    order of name, repeating.
    """
    text = F.col(text_col)
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")] if whole_rows else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("tie"), *own)
    digits = max(1, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    named = F.coalesce(F.col("id").cast("string"), F.col("tie").cast("string"))  # rows without id are spread by their text
    place = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # not null, for joins by equality
    rows = rows.withColumn("place", place).withColumn("digest", F.md5(named.cast("binary"))).withColumn("bucket", F.substring("digest", 1, digits))
    sums = rows.groupBy("source", "place", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source", "place").agg(F.sum("bucket_size").alias("source_size")), list(weights), share, float(repeat))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).select("place", "bucket", "offset").join(targets.drop("source"), "place")
    inside = Window.partitionBy("place", "bucket").orderBy("digest", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["place", "bucket"])
    pick = (F.pmod(F.col("rank"), F.lit(len(schedules))) + 1).cast("int")
    begin, end = (F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), pick) for i in (0, 1))
    due = F.floor("target")

    def copy(k: int) -> Column:
        at = F.col("offset") + F.col("inner") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), due - at)).cast("long")
        where = position((at / F.greatest(F.lit(1.0), F.col("target"))).cast("double"), begin, end)
        return F.struct(F.lit(k).alias("copy"), words.alias("words"), where.alias("position"))

    rows = rows.withColumn("copies", F.filter(F.array(*map(copy, range(repeat))), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "copies", *(["own"] if whole_rows else []))


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of mix() with position and position_again (of the first and the second copy; null where there is
    none), range-partitioned and sorted by position; documents that are not taken come last."""
    at = lambda i: F.get(F.col("copies"), F.lit(i))["position"]
    order = (F.col("position").asc_nulls_last(), F.col(id_col))
    return mixed.withColumn("position", at(0)).withColumn("position_again", at(1)).repartitionByRange(*order).sortWithinPartitions(*order)


def scheduled(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus in training order: the rows of docs, once for each copy taken, with mix_copy, mix_words
    and mix_position, range-partitioned and sorted by position. Columns of docs with these three names are
    replaced. Rows carry all their columns through the plan, so none is looked up by its id."""
    plan = mix(docs.drop("mix_copy", "mix_words", "mix_position"), id_col=id_col, whole_rows=True, **options)
    each = plan.select("own", F.explode("copies").alias("c"))
    out = each.select("own.*", F.col("c.copy").alias("mix_copy"), F.col("c.words").alias("mix_words"), F.col("c.position").alias("mix_position"))
    return out.repartitionByRange("mix_position", id_col).sortWithinPartitions("mix_position", id_col, "mix_copy")
