"""Connected components of an edge table, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.storage import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round: link each node's larger (or smaller) neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    # A hub's neighbours are never gathered: the minimum is combined before the shuffle and joined back.
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.filter("v > u" if larger else "true").join(least, "u")
    linked = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def written(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``df`` (u, v) as written to the shared folder, with its count and an order-free checksum, taken while writing.

    A task that runs twice may be counted twice: equal states mean equal tables, unequal ones need not.
    """
    seen = Observation()
    state = (
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("v", "u")).alias("x"),
    )
    table = materialize(df.observe(seen, *state), name)
    found = seen.get
    return table, (found["n"], found["s"], found["x"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (``u``, ``v`` bigint); component is the smallest node reachable.

    Self-links and null ends are ignored; an empty edge table gives an empty result.  Every round is written to the
    shared folder; rounds stop when the edges no longer change.
    """
    clean = edges.filter("u is not null and v is not null and u <> v")
    current, state = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while state[0] and state != seen:
        seen = state
        current, state = written(_star(_star(current, True), False), "cc")
    # Now every node points at its component's smallest one.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def merge_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, comp: the smallest node of its component so far) after more ``edges`` between nodes.

    Only the components that the edges join take part, each as one node.
    """
    one = roots.select(F.col("node").alias("u"), F.col("comp").alias("_cu"))
    two = roots.select(F.col("node").alias("v"), F.col("comp").alias("_cv"))
    between = edges.join(one, "u").join(two, "v").select(F.col("_cu").alias("u"), F.col("_cv").alias("v"))
    joined = connected_components(between).select(F.col("node").alias("comp"), "component")
    return materialize(
        roots.join(joined, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")), "roots"
    )
