"""Connected components by contraction within the tasks of two dealings of the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import HOT, cut, drop

EDGES = "hi long, lo long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ids of edges a-b, the least id that each reaches by them)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        least, now = np.minimum(root[x], root[y]), root.copy()
        for end in (root[x], root[y]):
            np.minimum.at(now, end, least)
        now = now[now]
        if np.array_equal(now, root):
            return ids, ids[root]
        root = now


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (hi, lo, own) of a task -> the nodes of its own edges, each with the least id that all its edges reach from it.

    Edges that are not its own only tell what lies below a node, so an edge comes out of one task."""
    parts = [pdf for pdf in batches if len(pdf)]
    if not parts:
        return
    hi, lo, own = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("hi", "lo", "own"))
    ids, root = local_roots(hi, lo)
    out = np.isin(ids, np.concatenate([hi[own], lo[own]])) & (ids != root)
    yield pd.DataFrame({"hi": ids[out], "lo": root[out]})


def _mine(edges: DataFrame) -> DataFrame:
    return edges.withColumn("own", F.lit(True)).mapInPandas(_contracted, EDGES)


def _folded(edges: DataFrame) -> DataFrame:
    """All edges of a node to smaller ones meet: it and they move to the smallest that is found."""
    return _mine(edges.repartition("hi"))


def _state(edges: DataFrame) -> tuple[bool, list[tuple[int, int]]]:
    """Whether the edges form stars, and the (node, tasks to share them) of nodes that a HOTth of all edges or more lead to."""
    total = max(1, edges.count())
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    loose = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    hot = F.when(F.col("down") * HOT >= total, F.struct("node", "down"))
    found = nodes.agg(F.bool_or(loose).alias("loose"), F.collect_list(hot).alias("hot")).first()
    return not found["loose"], [(r["node"], -(-r["down"] * HOT // total)) for r in found["hot"]]


def _jumped(spark: SparkSession, edges: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """The edges that lead to a node meet those that lead on from it, and move to the smallest that is found. A hot node's are
    dealt over as many tasks as it holds shares of all edges; what leads on from it goes to each of them."""
    shares = F.broadcast(spark.createDataFrame(hot, "node long, shares long"))
    both = edges
    for end in ("hi", "lo"):
        both = both.join(shares.select(F.col("node").alias(end), F.col("shares").alias(f"{end}_shares")), end, "left")
    one = F.lit(1).cast("long")
    own = F.struct(F.xxhash64("lo", F.pmod(F.xxhash64("hi"), F.coalesce("lo_shares", one))).alias("at"), F.lit(True).alias("own"))
    below = F.transform(F.sequence(one - 1, F.coalesce("hi_shares", one) - 1), lambda i: F.struct(F.xxhash64("hi", i).alias("at"), F.lit(False).alias("own")))
    dealt = both.select("hi", "lo", F.explode(F.concat(F.array(own), below)).alias("to")).select("hi", "lo", "to.own", "to.at")
    return dealt.repartition("at").select("hi", "lo", "own").mapInPandas(_contracted, EDGES)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids -> (node, component), component the smallest id reachable.

    Each task first contracts the edges it reads to a forest, so a node has at most one edge a task to smaller ones. Then
    in every round edges meet at the node they lead to (hot ones in shares) and at the node they come from, and each
    task moves all it can connect to the smallest id, until the edges form stars. A round is three shuffles of
    edges, however large a star is; their number grows with the logarithm of the longest path, and an edge makes at most
    one more a round. Each round is written to the shared folder. Self-loops, repeated and reversed edges are allowed; no
    edges give no rows.
    """
    a, b = (F.col(c) for c in edges.columns)
    ordered = edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = cut(_folded(_mine(ordered)), "cc")
    while True:
        stars, hot = _state(now)
        if stars:
            break
        after = cut(_folded(_jumped(edges.sparkSession, now, hot)), "cc")
        drop(now)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
