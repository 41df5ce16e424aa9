"""Linking rows that share bucket keys, and connected components, on DataFrames.

No bucket's pairs are all written out: each bucket is first linked through one pivot,
the member that shares most with others, and only rows that this leaves in different
components are compared further.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.llm.shared import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for all ids in ``edges(a, b)``: the smallest id reachable.

    Each round every vertex takes the smallest label among itself and its
    neighbours, then follows its label's own label (pointer jumping), until
    nothing changes. Joins only, so a vertex with many neighbours is split by AQE.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")).filter("id <> other").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").select("id", "component", F.lit(None).cast("long").alias("was"))
        own = labels.select("id", "component", F.col("component").alias("was"))
        step = near.unionByName(own).groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        step = materialize(step, "step")
        if step.filter("component <> was").isEmpty():
            return labels
        up = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        labels = materialize(step.join(up, "component").select("id", F.least("component", "up").alias("component")), "labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(id, component)`` with the components joined that ``links(a, b)`` connect.

    Components are followed, not ids, so this costs as many rows as there are links;
    ids that had no component get one.
    """
    at = [labels.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab"]
    named = links.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    over = connected_components(named).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    fresh = ids.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    out = labels.unionByName(fresh).join(over, "component", "left")
    return materialize(out.select("id", F.coalesce("joined", "component").alias("component")), "labels")


#: Rows of a mixed bucket up to which its pairs are screened in a join.
SMALL = 64
#: Rows a block of a larger mixed bucket holds.
BLOCK_ROWS = 4000


def dealt_blocks(left: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of buckets dealt to pairs of blocks (key, low, high), each block of weight ``most`` or about.

    Every two rows of a bucket meet in exactly one pair of blocks, so a hot bucket is
    spread over as many tasks as it has pairs of blocks.
    """
    blocks = materialize(left.groupBy("key").agg(F.ceil(F.sum(weight) / most).cast("long").alias("blocks")), "blocks")
    dealt = left.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")


def link_buckets(
    keys: DataFrame,
    sigs: DataFrame,
    screen: Callable[[Column, Column], Column],
    prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    compare: Callable[[DataFrame], DataFrame],
    remaining: Callable[[DataFrame], DataFrame] | None = None,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Connected components of the verified links among ids that share a key.

    ``keys(key long, id long)``: an id has one row for each of its keys, or more;
    ``sigs(id, sig)`` has one row for each id. ``screen(sig, sig)`` is a cheap necessary
    condition; ``prepare(ids(id))`` readies all that share a key, once, and gives the
    ``verify(pairs(a, b))`` that keeps the pairs (a < b) that are really linked.
    What the pivots leave mixed, rows(key, id, sig, label), is compared in two ways:
    buckets of up to SMALL rows in an equi-join under ``screen``, larger ones by
    ``compare(rows)``, which finds the links (a, b) between different labels itself,
    block against block; or all of them by ``remaining(rows)``. ``narrow(wanted(key))`` may give the rows
    of ``keys`` with fewer of other keys than the wanted. Returns (id, component) for ids with at least one link. No link between two
    ids that share a key and pass ``screen`` is lost, except one whose ends are
    connected anyway.
    """
    # a bucket of two is known by its smallest and largest id; only larger ones are read again
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    buckets = materialize(buckets.filter("low < high"), "buckets")
    large_keys = materialize(buckets.filter("n > 2").select("key"), "large-keys")
    large = (keys if narrow is None else narrow(large_keys)).join(large_keys, "key").select("key", "id").distinct()
    two = buckets.filter("n = 2")
    ids = two.select("key", F.col("low").alias("id")).union(two.select("key", "high")).union(large)
    members = materialize(ids.join(sigs, "id").select("key", "id", "sig"), "members")
    verify = prepare(members.select("id").distinct())

    # the pivot of a bucket is the member that meets most others over all its buckets
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    degree = members.select("key", "id").join(sizes, "key").groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = members.select("key", "id").join(degree, "id")
    top = ranked.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("top")).select("key", F.col("top.id").alias("pivot"), "top.degree")
    pivots = top.join(sigs.select(F.col("id").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    pivots = materialize(pivots, "pivots")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        return materialize(verify(pairs), "links")

    star = members.join(pivots, "key").filter((F.col("id") != F.col("pivot")) & screen(F.col("sig"), F.col("pivot_sig")))
    star = materialize(star.groupBy("id", "pivot").agg(F.max("degree").alias("degree")), "star")
    # each id first meets its busiest pivot; the others only matter where that leaves them apart
    first = star.groupBy("id").agg(F.max(F.struct("degree", "pivot")).alias("top"))
    labels = connected_components(confirmed(first.select(F.col("top.pivot").alias("a"), F.col("id").alias("b"))))
    of = labels.withColumnRenamed("component", "of_pivot").withColumnRenamed("id", "pivot")
    apart = star.join(labels, "id", "left").join(of, "pivot", "left")
    apart = apart.filter(F.coalesce("component", "id") != F.coalesce("of_pivot", "pivot")).join(first.select("id", F.col("top.pivot").alias("met")), "id")
    apart = confirmed(apart.filter("pivot <> met").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    if not apart.isEmpty():
        labels = merged(labels, apart)
    now = members.join(labels, "id", "left").select("key", "id", "sig", F.coalesce("component", "id").alias("label"))
    now = materialize(now, "labelled")
    # buckets of two were settled by their pivot
    mixed = now.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lowest"), F.max("label").alias("highest"))
    left = materialize(now.join(mixed.filter("lowest < highest and n > 2").select("key", "n"), "key"), "left")
    if remaining is not None:
        more = materialize(remaining(left.drop("n")), "more")
    else:
        x, y = (left.filter(F.col("n") <= SMALL).alias(side) for side in "xy")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & screen(F.col("x.sig"), F.col("y.sig")))
        more = confirmed(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        more = materialize(more.union(compare(left.filter(F.col("n") > SMALL).drop("n")).select("a", "b")).distinct(), "more")
    if more.isEmpty():
        return labels
    return merged(labels, more)
