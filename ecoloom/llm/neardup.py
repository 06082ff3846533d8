"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles; a document's sketch is the k least of its shingle hashes.
Equal shingle sets are one node. The inverted lists of retained values work twice:

* Screening, with few values a node: sets with Jaccard similarity j share about j * k of the k least
  hashes of their union. A node of which far fewer values (by `sigmas` standard deviations) stand in
  another sketch too is linked with nothing and goes no further.
* Candidates, with `k_wide` values of the nodes left. All values of a sketch are ordered by rarity; two
  linked nodes share one among the first s - o + 1 of either, where o is the least overlap that the
  pair's sizes allow (the prefix-filter argument; exact for sketches that hold their whole set, with the
  same standard deviations below otherwise). Only those values enter the lists.

In every list all members are first compared to a hub, the member with the most shared values; verified
links are joined into components, and only members of different components are then compared with each
other. So a large group of near copies costs a multiple of its size.

The union sketch of a pair estimates its similarity; pairs within `sigmas` standard deviations of the
threshold or above go on to the exact test on the full sets.

Without `sigmas` nothing is estimated: every node takes part with its whole set for a sketch, the prefix filter is
exact, and all pairs that it leaves are verified.

Defined results: a null or empty text has an empty set, n_shingles 0, and is linked with nothing. Rows
with equal ids are separate texts (an id in two groups is reported with each row's own group). A null
id never becomes a group's name while another id is there. Columns beside id and text are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoloom.llm.common import WordHashes, computed, hashes_of, shingle_hashes, stored, texts_of, words_of


#: More than any text has: a sketch of so many values is the whole set.
MOST_SHINGLES = 2**31 - 1


def shingle_set(text: str | None, known: WordHashes, width: int) -> np.ndarray:
    """The distinct shingles as ascending 63-bit numbers."""
    return np.unique(shingle_hashes(hashes_of(words_of(text), known), width) >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """docs(id, text) -> id, n_shingles, node (128-bit digest of the set; null when empty), sketch."""

    def describe():
        known = WordHashes()

        def of(batch):
            sets = [shingle_set(t, known, width) for t in texts_of(batch)]
            return [len(s) for s in sets], [node_of(s) for s in sets], [s[:k] for s in sets]

        return of

    return computed(docs, ["id"], {"n_shingles": "long", "node": "binary", "sketch": "array<long>"}, describe)


def node_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts(id, text) -> node, shingles; the node is computed anew, so an id with several texts does no harm."""

    def describe():
        known = WordHashes()

        def of(batch):
            sets = [shingle_set(t, known, width) for t in texts_of(batch)]
            return [node_of(s) for s in sets], sets

        return of

    return computed(texts.select("text"), [], {"node": "binary", "shingles": "array<long>"}, describe)


def slack(j: float, k: int, sigmas: float) -> float:
    """Share of k values that sets of similarity j have in common, less `sigmas` standard deviations."""
    return max(0.0, j - sigmas * math.sqrt(j * (1 - j) / k))


def screened(nodes: DataFrame, j: float, k: int, sigmas: float) -> DataFrame:
    """nodes(node, sketch) -> node: those with enough values that stand in two sketches or more."""
    values = nodes.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").select("v")
    least = F.when(F.col("s") < k, F.lit(j)).otherwise(F.lit(slack(j, k, sigmas))) * F.col("s")
    return values.join(common, "v").groupBy("node", "s").agg(F.count("*").alias("shared")).filter(F.col("shared") >= F.floor(least)).select("node")


def least_overlap(n1: Column, n2: Column, j: float, k: int, sigmas: float) -> Column:
    """Values that the sketches of linked sets of n1 and n2 shingles share at least.

    Linked sets share j / (1 + j) * (n1 + n2) shingles. Of these about k / greater of n1, n2 stand in both
    sketches when one is cut off at k values.
    """
    both, most = F.lit(j / (1 + j)) * (n1 + n2), F.greatest(n1, n2)
    share = F.least(F.lit(1.0), both / most)
    cut = F.lit(float(k)) * share - F.lit(sigmas) * F.sqrt(F.lit(float(k)) * (share * (1 - share) + F.lit(0.01)))
    return F.when(most <= k, F.ceil(both - 1e-6)).otherwise(F.greatest(F.floor(cut), F.lit(1)))


def postings(nodes: DataFrame, j: float, k: int, sigmas: float) -> DataFrame:
    """nodes(node, n, sketch) -> v, node, n, s, pos, shared: the inverted lists of two nodes and more.

    pos: the value's place, from 1, when the sketch is ordered by rarity; shared: the node's values that
    stand elsewhere too.
    """
    values = nodes.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = Window.partitionBy("node")  # k rows at most
    shared = values.join(common, "v").withColumn("shared", F.count("*").over(by_node))
    placed = shared.withColumn("pos", F.col("s") - F.col("shared") + F.row_number().over(by_node.orderBy("df", "v")))
    exact = F.ceil(F.lit(j) * F.col("n") - 1e-6)  # least_overlap() with the partner that allows the least
    cut = F.lit(max(1, math.floor(k * j - sigmas * math.sqrt(k * (j * (1 - j) + 0.01)))))
    most = F.col("s") - F.when(F.col("n") / F.lit(j) <= k, exact).otherwise(F.least(exact, cut)) + 1
    return placed.filter(F.col("pos") <= most).select("v", "node", "n", "s", "pos", "shared")


def may_link(a: str, b: str, j: float, k: int, sigmas: float) -> Column:
    """Size and place of two postings (structs n, s, pos) of one list allow a link."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    o = least_overlap(n1, n2, j, k, sigmas)
    fits = F.least(n1, n2) >= F.lit(j - 1e-9) * F.greatest(n1, n2)
    return fits & (F.col(f"{a}.pos") <= F.col(f"{a}.s") - o + 1) & (F.col(f"{b}.pos") <= F.col(f"{b}.s") - o + 1)


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, j: float, sigmas: float) -> DataFrame:
    """Keeps the pairs (a, b) whose union sketch may reach j."""
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    m = F.size(least)
    hits = F.size(F.array_intersect(F.array_intersect("sa", "sb"), least))
    return both.filter(hits >= F.lit(j) * m - F.lit(sigmas * math.sqrt(j * (1 - j))) * F.sqrt(m)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Keeps the pairs with 100 * |intersection| >= percent * |union|."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("tb"))
    same = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").filter(100 * same >= percent * (F.size("ta") + F.size("tb") - same)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: the least node reachable. Labels spread along links and then jump to
    their label's label, so the rounds grow with the logarithm of the longest chain; every round is
    written to the shared folder."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("r"))
        near = labels.join(spread, labels["node"] == spread["a"]).select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = near.select(F.col("node").alias("up"), F.col("root").alias("top"))
        after = stored(near.join(up, near["root"] == up["up"]).select("node", "old", F.least("root", "top").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.filter("root < old").isEmpty():
            return labels


def deduplicate(
    docs: DataFrame, percent: int = 85, width: int = 5, k: int = 32, k_wide: int = 512, sigmas: float | None = 5.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs; see the module's text.

    A true link is lost only if a sketch shows it `sigmas` standard deviations less alike than it is: less than
    one in a million links at 5.5. With sigmas None no link is lost, at the cost of lists of all shingles.
    """
    j = percent / 100
    whole = sigmas is None
    if whole:
        k_wide, sigmas = MOST_SHINGLES, 0.0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = stored(sketches(rows, width, k), "sketches")
    nodes = each.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.any_value("sketch").alias("sketch"))
    alike = stored(nodes.select("node") if whole else screened(nodes.select("node", "sketch"), j, k, sigmas), "screened")

    # the full set of each node left, from one text that has it
    holders = nodes.join(alike, "node", "left_semi").select(F.col("least").alias("holder")).distinct()
    texts = rows.join(holders, F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    sets = stored(full_sets(texts, width).join(alike, "node", "left_semi").dropDuplicates(["node"]), "sets")
    near = sets.select("node", F.size("shingles").alias("n"), F.slice("shingles", 1, k_wide).alias("sketch"))
    lists = stored(postings(near, j, k_wide, sigmas), "postings")

    def linked(pairs: DataFrame) -> DataFrame:
        return verified(pairs if whole else estimated(pairs, near, k_wide, j, sigmas), sets, percent)

    hubs = lists.groupBy("v").agg(F.max(F.struct((F.col("shared") / F.col("s")).alias("typical"), "node", "n", "s", "pos")).alias("hub"), F.count("*").alias("members")).filter("members > 1").select("v", "hub")
    star = lists.select("v", F.struct("node", "n", "s", "pos").alias("x")).join(hubs, "v").filter((F.col("x.node") != F.col("hub.node")) & may_link("x", "hub", j, k_wide, sigmas))
    star = star.select(F.least("x.node", "hub.node").alias("a"), F.greatest("x.node", "hub.node").alias("b")).distinct()
    links = stored(linked(star), "star-links")
    roots = components(links)

    # what stands in one list but in different components so far
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = rooted.groupBy("v").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("v")
    listed = F.array_sort(F.collect_list(F.struct("pos", "v")).over(Window.partitionBy("node")))["v"]
    rest = rooted.join(open_lists, "v", "left_semi").withColumn("prefix", listed)
    x = rest.select("v", F.struct("node", "root", "n", "s", "pos", "prefix").alias("x"))
    y = rest.select("v", F.struct("node", "root", "n", "s", "pos", "prefix").alias("y"))
    rarest = F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == x["v"]  # each pair once, in its rarest list
    shared = (x["v"] == y["v"]) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    cross = x.join(y, shared & may_link("x", "y", j, k_wide, sigmas) & rarest).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    cross = cross.join(star, ["a", "b"], "left_anti")
    more = stored(linked(cross), "cross-links")
    if not more.isEmpty():
        roots = components(links.union(more))

    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(names, "root").select("node", "component")
    out = each.select("id", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
