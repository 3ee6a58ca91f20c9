"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label and length are compared when their cosine may reach the threshold. Equal vectors form a class
of which one goes on, so copies of a very common vector cost nothing. Unit vectors are turned onto the principal
axes (covariance summed by Spark over all vectors); those that reach the threshold t are within sqrt(2 - 2t) of each
other, also in the plane of the first two axes. So vectors are laid into square cells of that width in the plane, cells
are cut into tiles of about TILE vectors, and a vector meets the tiles of its own cell and of those adjacent cells that
are no farther from it than that width. Within a pair of tiles the leading dimensions are
multiplied first; what is left is bounded by the product of the suffix norms, and pairs that cannot reach the
threshold stop there. The survivors' cosines are computed in full, in double precision, from the original vectors.

A pair of tiles returns the number of links of each vector and a spanning forest of its links, never the pairs. Where
all vectors of a label lie in a few cells, each meets all of these, TILE at a time: the work is then quadratic in them.

Defined cases: a null label or vector, a zero or empty vector, or one that holds null or non-finite components links
with nothing; vectors of different lengths never link; each row counts as a vector, also if vec_id repeats; a null
vec_id is linked but never names a component; an empty table gives no rows. Labels may be of any type that can be a
join key, components floats or doubles of either width, which keep their precision; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, join_keys, table
from kelvinlake.llm.graph import connected_components

THRESHOLD, TILE, LEAD, SLACK = 0.98, 2048, 16, 1e-9
#: Pairs whose bounds are held at once: a strip of one tile against the other.
STRIP = 256


def covariances(classes: DataFrame) -> dict[int, np.ndarray]:
    """Second moments of the unit vectors, by vector length: d rows of d numbers for each length reach the driver, and
    each task sends as many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, group in pdf.groupby("d"):
                x = unit(np.stack(group["vector"].to_numpy()))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pd.DataFrame({"d": d, "i": np.arange(d), "row": [r.tobytes() for r in s]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
        return pd.DataFrame({"d": pdf["d"].iloc[:1], "i": pdf["i"].iloc[:1], "row": [total.tobytes()]})

    schema = "d int, i int, row binary"
    rows = classes.select("d", "vector").mapInPandas(run, schema).groupBy("d", "i").applyInPandas(add, schema).collect()
    out = {d: np.zeros((d, d)) for d in {r["d"] for r in rows}}
    for r in rows:
        out[r["d"]][r["i"]] = np.frombuffer(r["row"])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(moments: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in moments.items()}


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs with cosine of at least threshold; i < j if both sides are the same tile."""
    ua, ub = unit(a), unit(b)
    pa, pb = ua @ axes, ub @ axes
    rest = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0))
    ra, rb = rest(pa), rest(pb)
    d, lead = pa.shape[1], min(LEAD, pa.shape[1])
    wide = lambda x: x.astype(np.float64)
    size_a, size_b = (np.linalg.norm(wide(x), axis=1) for x in (a, b))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for top in range(0, len(a), STRIP):
        part = pa[top : top + STRIP, :lead] @ pb[:, :lead].T
        bound = part + (np.outer(ra[top : top + STRIP, lead], rb[:, lead]) if lead < d else 0)
        i, j = np.nonzero(bound >= threshold - SLACK)
        if same:
            i, j = i[i + top < j], j[i + top < j]
        for at in range(0, len(i), 65536):
            x, y = i[at : at + 65536], j[at : at + 65536]
            dot = part[x, y]
            x = x + top
            for lo in range(lead, d, LEAD):
                hi = min(lo + LEAD, d)
                dot = dot + np.einsum("ij,ij->i", pa[x, lo:hi], pb[y, lo:hi])
                left = ra[x, hi] * rb[y, hi] if hi < d else 0
                go = dot + left >= threshold - SLACK
                x, y, dot = x[go], y[go], dot[go]
            cos = np.einsum("ij,ij->i", wide(a[x]), wide(b[y])) / (size_a[x] * size_b[y])
            found.append((x[cos >= threshold], y[cos >= threshold]))
    return tuple(np.concatenate(z) for z in zip(*found))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def similar_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), a row for each row."""
    v = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & whole & F.exists(v, lambda x: x != 0)
    keyed = rows.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    keyed = keyed.withColumn("v1", F.xxhash64("embedding")).withColumn("v2", F.xxhash64(F.lit(7), F.col("embedding")))
    key = ["label", "v1", "v2"]
    grouped = keyed.filter("usable").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max(F.col("embedding")).alias("vector"))
    node = F.xxhash64("label", "v1", "v2").alias("node")
    classes = cut(grouped.select(*key, node, "rep", "copies", F.size("vector").alias("d"), "vector"), "vectors")

    axes = principal_axes(covariances(classes))
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK
    types = {f.name: f.dataType.simpleString() for f in classes.schema}

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.zeros((len(pdf), 2))
            for d, own in pdf.groupby("d").indices.items():
                at[own, : min(2, d)] = unit(np.stack(pdf["vector"].to_numpy()[own])) @ axes[d][:, :2] / width
            cell = np.floor(at).astype(np.int64)
            yield pdf.assign(cx=cell[:, 0], cy=cell[:, 1], px=at[:, 0] - cell[:, 0], py=at[:, 1] - cell[:, 1])

    schema = f"label {types['label']}, node long, copies long, d int, vector {types['vector']}, cx long, cy long, px double, py double"
    placed = cut(classes.select("label", "node", "copies", "d", "vector").mapInPandas(cells, schema), "cells")
    # the tiles of each cell that has members, and those of the cells beside it
    where = ["label", "d", "cx", "cy"]
    sizes = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]
    beside = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in steps))).alias("step")
    offered = sizes.select("label", "d", "cx", "cy", "tiles", beside).select("label", "d", (F.col("cx") - F.col("step.dx")).alias("cx"), (F.col("cy") - F.col("step.dy")).alias("cy"), F.struct("step.dx", "step.dy", F.col("tiles").alias("k")).alias("cell"))
    near = sizes.join(offered.groupBy(*where).agg(F.collect_list("cell").alias("near")), where, "left").select(*where, "n", "tiles", "near")
    laid = join_keys(placed, cut(near, "tiles"), where, "n", placed.count()).withColumn("tile", F.pmod("node", "tiles").cast("int"))
    # a meeting is named by its lower cell, the step to the upper one, and a tile of each
    tile, meeting = F.col("tile"), lambda cx, cy, dx, dy, x, y, left, right: F.struct(cx.alias("ax"), cy.alias("ay"), dx.alias("dx"), dy.alias("dy"), x.alias("x"), y.alias("y"), left.alias("left"), right.alias("right"))
    zero, upto = F.lit(0), lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(upto(F.col("tiles")), lambda k: meeting(F.col("cx"), F.col("cy"), zero, zero, F.least(tile, k), F.greatest(tile, k), tile <= k, tile >= k))
    gap = lambda step, p: F.when(step > 0, 1 - p).when(step < 0, p).otherwise(0.0)
    in_reach = lambda c: F.pow(gap(c["dx"], F.col("px")), F.lit(2)) + F.pow(gap(c["dy"], F.col("py")), F.lit(2)) <= 1 + 1e-6
    upper = lambda c: (c["dx"] > 0) | ((c["dx"] == 0) & (c["dy"] > 0))
    up = F.flatten(F.transform(F.filter("near", lambda c: in_reach(c) & upper(c)), lambda c: F.transform(upto(c["k"]), lambda k: meeting(F.col("cx"), F.col("cy"), c["dx"], c["dy"], tile, k, F.lit(True), F.lit(False)))))
    down = F.flatten(F.transform(F.filter("near", lambda c: in_reach(c) & ~upper(c)), lambda c: F.transform(upto(c["k"]), lambda k: meeting(F.col("cx") + c["dx"], F.col("cy") + c["dy"], -c["dx"], -c["dy"], k, tile, F.lit(False), F.lit(True)))))
    none = F.array().cast("array<struct<ax:bigint,ay:bigint,dx:int,dy:int,x:int,y:int,left:boolean,right:boolean>>")
    meets = laid.select("label", "d", "node", "copies", "vector", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none))).alias("m")).select("label", "d", "node", "copies", "vector", "m.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf[side]].sort_values("node") for side in ("left", "right"))
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "other": [], "links": []})
        same = not pdf["dx"].iloc[0] and not pdf["dy"].iloc[0] and pdf["x"].iloc[0] == pdf["y"].iloc[0]
        i, j = linked_pairs(np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy()), axes[int(pdf["d"].iloc[0])], threshold, same)
        nodes = left["node"].to_numpy() if same else np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
        copies = left["copies"].to_numpy() if same else np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()])
        j = j if same else j + len(left)
        links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        held = np.flatnonzero(links)
        edges = np.array(forest(len(nodes), i, j), np.int64).reshape(-1, 2)
        return pd.concat([pd.DataFrame({"node": nodes[held], "other": nodes[held], "links": links[held]}), pd.DataFrame({"node": nodes[edges[:, 0]], "other": nodes[edges[:, 1]], "links": 0})])

    found = cut(meets.groupBy("label", "d", "ax", "ay", "dx", "dy", "x", "y").applyInPandas(compare, "node long, other long, links long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("node <> other").select("node", "other"))
    named = cut(classes.select("node", "rep").join(parts, "node", "left").withColumn("group", F.coalesce("component", "node")), "named")
    least = named.groupBy("group").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n"))
    grouped = join_keys(named.select("node", "group"), least, ["group"], "n", named.count())
    per_class = classes.select(*key, "node", "copies").join(grouped.select("node", "least"), "node").join(counts, "node", "left")
    per_class = cut(per_class.select(*key, "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least"), "classes")
    found_rows = join_keys(keyed.filter("usable").drop("embedding"), per_class, key, "copies", rows.count())
    alone = keyed.filter("not usable").select("vec_id", F.lit(None).cast("long").alias("links"), F.col("vec_id").alias("least"))
    out = found_rows.select("vec_id", "links", "least").unionByName(alone)
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP6_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN counts c ON e.vec_id = c.a
"""
