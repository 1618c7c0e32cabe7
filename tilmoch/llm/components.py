"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.session import drop_shared, shared_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(nid, cid)`` for every node of ``edges (a, b)``: cid is the smallest node of its component.

    Loops, repeated and reversed edges make no difference; an empty table gives an
    empty result. Each round is a minimum per node (combined before the shuffle,
    so a hub of any degree is cheap) and a join back on it; the edge table is
    written to the shared folder each round, so lineage stays short and a lost
    executor costs one round, and the table before it is deleted. A table that still
    changes after max_rounds is an error, not a result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = shared_table(now, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(now.join(low, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        nxt = shared_table(nxt.where("a <> b").distinct(), "edges")
        new = _state(nxt)
        drop_shared(now)
        now = nxt
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"the components still change after {max_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("cid")).select(F.col("a").alias("nid"), "cid").union(now.select(F.col("b").alias("nid"), F.col("b").alias("cid")).distinct())
