"""Connected components by randomised contraction, for identifiers of any orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitmark.session import discard, written


def stars(ties: DataFrame, node: str = "node", hub: str = "hub") -> DataFrame:
    """(a, b): edges with the components of ``ties``, in which each node is tied to a bounded number of hubs.

    A node keeps one edge, to the smallest of its hubs; its other hubs are tied to that one. Many nodes share their hubs, and those
    edges are the same ones, so what is left is about one edge a node.
    """
    held = ties.groupBy(F.col(node).alias("n")).agg(F.min(hub).alias("low"), F.collect_set(hub).alias("hubs"))
    ends = F.array_union("hubs", F.array("n"))
    return held.select(F.explode(ends).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", nodes: int | None = None) -> DataFrame:
    """(node, label) for every node of the edges; nodes are connected exactly where their labels are equal, and the label is a node
    of the component, the same one at every run.

    A round hands every node on to the neighbour (or itself) that comes first in an order by hash, another one in each round, and
    keeps the edges between those that were handed to, without loops and repeats. An expected share of the nodes goes in every
    round, so edges shrink geometrically and a group of many copies is a single node after a round or two. Minima are combined
    before they are shuffled. Each round ends in written tables (``nodes``: about how many there are at most); nothing but the
    question whether an edge is left comes to the driver. Null ends drop out, loops and repeated edges do no harm.
    """
    left = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges", nodes and 4 * nodes)
    hops: list[DataFrame] = []
    while True:
        placed = lambda c: F.struct(F.xxhash64(c, F.lit(len(hops))).alias("at"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(placed("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", placed("u"))["node"].alias("up"))
        hops.append(written(first, "hops", nodes))
        one, two = (hops[-1].select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "uv")
        moved = left.join(one, "u").join(two, "v").where("u_up <> v_up")
        less = written(moved.select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v")).distinct(), "edges", nodes and 4 * nodes)
        discard(left)
        left = less
        if not left.limit(1).count():
            break
    discard(left)
    found = hops[-1].withColumnRenamed("up", "label")
    for hop in reversed(hops[:-1]):
        on = found.select(F.col("node").alias("up"), "label")
        found = hop.join(on, "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    found = written(found, "labels", nodes)
    discard(*hops)
    return found
