"""The two learned models of each unit: an isolation forest and a residual network.

A tree learns from SAMPLE rows of its unit that Spark draws and joins by row number, so trees grow in groups of one tree
each. The network learns from all rows of its unit: a unit's rows are dealt by a hash into shards of about SHARD rows, in
each round every shard descends for some epochs from the unit's weights, and the shards' weights are averaged by their
rows. A tenth of the rows is held back in all shards and tells when to stop. Weights lie in a table of one row a unit
between rounds. Scoring deals each unit's rows into shards as well, each of which meets the unit's models in a cogroup, so a
long series is many tasks. Seeds and draws depend on the unit's name, so a retried task gives the same model.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.functions.scalar import WARMUP
from kelvinlake.tables import settle

TREES, SAMPLE, HIDDEN, EPOCHS, BATCH, PATIENCE = 80, 256, 24, 130, 48, 22
SHARD = 100_000
#: Averagings of the shards' weights; EPOCHS and PATIENCE are shared out between them.
ROUNDS = 10
HYPER = {"trees": TREES, "sample": SAMPLE, "hidden": HIDDEN, "epochs": EPOCHS, "batch": BATCH, "patience": PATIENCE}


# --- isolation forest ---------------------------------------------------------------------------------------------


def path_norm(n: int) -> float:
    """Expected path length of n points; 1 for a single one."""
    return 1.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def depth_limit(m: int) -> int:
    return int(np.ceil(np.log2(max(2, m)))) + 2


def grow(x: np.ndarray, depth: int, rng: np.random.Generator):
    """A tree: the number of its points, or (feature, cut, tree below the cut, tree from it on). One feature is drawn a
    node, and up to eight cuts until both sides hold points."""
    if depth == 0 or len(x) <= 1:
        return len(x)
    f = int(rng.integers(x.shape[1]))
    lo, hi = x[:, f].min(), x[:, f].max()
    if hi - lo < 1e-12:
        return len(x)
    for _ in range(8):
        cut = rng.uniform(lo, hi)
        left = x[:, f] < cut
        if left.any() and not left.all():
            return f, cut, grow(x[left], depth - 1, rng), grow(x[~left], depth - 1, rng)
    return len(x)


def lengths(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:
    """Path length of each row: its leaf's depth and what the leaf's points would still need."""
    if isinstance(tree, int):
        return np.full(len(x), depth + path_norm(tree))
    f, cut, low, high = tree
    left = x[:, f] < cut
    out = np.empty(len(x))
    out[left], out[~left] = lengths(low, x[left], depth + 1), lengths(high, x[~left], depth + 1)
    return out


def forest_scores(trees: list, m: int, x: np.ndarray) -> np.ndarray:
    """2^(-mean path / expected path); 0 without trees. m: rows a tree was grown from."""
    if not trees:
        return np.zeros(len(x))
    return 2.0 ** (-np.mean([lengths(t, x) for t in trees], axis=0) / path_norm(m))


# --- residual network ---------------------------------------------------------------------------------------------


def fresh_network(inputs: int, seed: int) -> list[np.ndarray]:
    """One hidden layer of ReLUs."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, (2 / inputs) ** 0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]


def flat(w: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in w])


def shaped(x: np.ndarray) -> list[np.ndarray]:
    n = (len(x) - 1) // HIDDEN - 2  # inputs
    cuts = np.split(np.asarray(x, float), np.cumsum([n * HIDDEN, HIDDEN, HIDDEN]))
    return [cuts[0].reshape(n, HIDDEN), *cuts[1:]]


def descend(w: list[np.ndarray], x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> list[np.ndarray]:
    """w after some epochs of momentum descent in batches, with gradients clipped."""
    w = [p.copy() for p in w]
    v = [np.zeros_like(p) for p in w]
    rows = np.arange(len(x))
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            b = rows[at : at + BATCH]
            h = np.maximum(0, x[b] @ w[0] + w[1])
            err = (h @ w[2] + w[3] - y[b]) / len(b)
            back = np.outer(err, w[2]) * (h > 0)
            for p, m, g in zip(w, v, (x[b].T @ back, back.sum(0), h.T @ err, np.array([err.sum()]))):
                m *= 0.9
                m -= 0.02 * np.clip(g, -40, 40)
                p += m
    return w


def predict(w: list[np.ndarray] | None, x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x)) if w is None else np.maximum(0, x @ w[0] + w[1]) @ w[2] + w[3]


# --- jobs ---------------------------------------------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def fit_units(features: DataFrame) -> DataFrame:
    """features(equipment_id, rn, if_x, mlp_x, y), rn from 1 on without gaps -> (equipment_id, part, model): TREES rows with
    a tree each and one (part -1) with the network. Rows of the warm-up are not learned from."""
    trained = features.filter(F.col("rn") > WARMUP)
    sizes = trained.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n"))
    m = F.least(F.lit(SAMPLE), F.greatest(F.lit(2), F.col("n"))).cast("int")
    # SAMPLE draws a tree, with replacement: each a hash of (unit, tree, draw)
    draws = sizes.select("equipment_id", "n", m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("part"))
    draws = draws.select("equipment_id", "n", "m", "part", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("draw"))
    drawn = draws.select("equipment_id", "part", "m", "draw", (F.pmod(F.xxhash64("equipment_id", "part", "draw"), F.col("n")) + WARMUP + 1).cast("int").alias("rn"))
    # TREES x SAMPLE draws a unit, which the size of features does not tell: they are never broadcast
    samples = drawn.hint("merge").join(trained.select("equipment_id", F.col("rn").cast("int").alias("rn"), "if_x"), ["equipment_id", "rn"])

    def one_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw")
        seed = [zlib.crc32(str(pdf["equipment_id"].iloc[0]).encode()), int(pdf["part"].iloc[0])]
        tree = grow(_matrix(pdf["if_x"]), depth_limit(len(pdf)), np.random.default_rng(seed))
        return pd.DataFrame({"equipment_id": pdf["equipment_id"].iloc[:1], "part": pdf["part"].iloc[:1], "model": [pickle.dumps((len(pdf), tree))]})

    schema = "equipment_id string, part int, model binary"
    forest = samples.select("equipment_id", "part", "draw", "if_x").groupBy("equipment_id", "part").applyInPandas(one_tree, schema)
    return forest.unionByName(fit_networks(trained))


def _learner(turn: int, epochs: int):
    """A shard's rows and its unit's weights -> the weights it descends to, and how far off they are on the rows held back."""

    def learn(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or own.empty:
            return pd.DataFrame({"equipment_id": [], "w": [], "now": [], "n": [], "square": [], "held": []})
        unit, shard, now = own["equipment_id"].iloc[0], int(own["shard"].iloc[0]), own["w"].iloc[0]
        pdf = pdf.sort_values("rn")
        x, y, held = _matrix(pdf["mlp_x"]), pdf["y"].to_numpy(float), pdf["held"].to_numpy(bool)
        seed = zlib.crc32(str(unit).encode()) + 1
        w = fresh_network(x.shape[1], seed) if now is None else shaped(now)
        square = float(((predict(w, x[held]) - y[held]) ** 2).sum())
        after = descend(w, x[~held], y[~held], epochs, np.random.default_rng([seed, shard, turn]))
        return pd.DataFrame({"equipment_id": [unit], "w": [flat(after)], "now": [flat(w)], "n": [int((~held).sum())], "square": [square], "held": [int(held.sum())]})

    return learn


def fit_networks(trained: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """trained(equipment_id, rn, mlp_x, y) -> (equipment_id, part -1, model) for every unit of 20 rows or more."""
    sizes = trained.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")
    shards = F.ceil(F.col("n") / (shard_rows or SHARD))
    code = F.xxhash64("equipment_id", "rn")
    rows = trained.join(sizes.select("equipment_id", shards.alias("shards")), "equipment_id")
    rows = settle(rows.select("equipment_id", "rn", "mlp_x", "y", F.pmod(code, F.col("shards")).alias("shard"), (F.pmod(F.xxhash64(code), F.lit(10)) == 0).alias("held")), "network-rows")
    many = sizes.select("equipment_id", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"))
    none = F.lit(None).cast("array<double>")
    units = settle(sizes.select("equipment_id", none.alias("w"), none.alias("best"), F.lit(float("inf")).alias("best_loss"), F.lit(0).alias("waited")), "networks")
    patience = -(-PATIENCE * ROUNDS // EPOCHS)
    for turn in range(ROUNDS + 1):  # the last one tells how good the weights are
        epochs = EPOCHS // ROUNDS if turn < ROUNDS else 0
        still = units.filter(F.col("waited") < patience)
        if turn and still.limit(1).count() == 0:
            break

        asked = many.join(still.select("equipment_id", "w"), "equipment_id")
        seen = rows.join(still.select("equipment_id"), "equipment_id", "left_semi").groupBy("equipment_id", "shard")
        parts = settle(seen.cogroup(asked.groupBy("equipment_id", "shard")).applyInPandas(_learner(turn, epochs), "equipment_id string, w array<double>, now array<double>, n long, square double, held long"), "network-parts")
        means = parts.select("equipment_id", "n", F.posexplode("w").alias("i", "v")).groupBy("equipment_id", "i").agg((F.sum(F.col("v") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))).alias("v"))
        means = means.groupBy("equipment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("mean"))  # a few hundred weights
        loss = parts.groupBy("equipment_id").agg((F.sum("square") / F.greatest(F.lit(1), F.sum("held"))).alias("loss"), F.first("now").alias("now"))
        after = units.join(means.join(loss, "equipment_id"), "equipment_id", "left")
        better = F.col("loss") < F.col("best_loss") - 1e-4
        units = settle(
            after.select(
                "equipment_id", F.coalesce("mean", "w").alias("w"), F.when(better, F.col("now")).otherwise(F.col("best")).alias("best"), F.when(better, F.col("loss")).otherwise(F.col("best_loss")).alias("best_loss"),
                F.when(F.col("loss").isNull(), F.col("waited")).when(better, 0).otherwise(F.col("waited") + 1).alias("waited"),
            ), "networks",
        )

    def stored(batches):
        for pdf in batches:
            yield pd.DataFrame({"equipment_id": pdf["equipment_id"], "part": -1, "model": [pickle.dumps(None if x is None else shaped(x)) for x in pdf["best"]]})

    return units.select("equipment_id", "best").mapInPandas(stored, "equipment_id string, part int, model binary")


def score_units(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """features of fit_units(), its result -> (equipment_id, rn, forest, pred) for every row."""
    shard = F.floor((F.col("rn") - 1) / SHARD)
    dealt = features.select("equipment_id", "rn", "if_x", "mlp_x", shard.alias("shard"))
    shards = features.groupBy("equipment_id").agg(F.max(shard).alias("last"))
    models = fitted.join(shards, "equipment_id").select("equipment_id", "part", "model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard"))

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"equipment_id": [], "rn": [], "forest": [], "pred": []})
        own = own.sort_values("part")
        loaded = [(p, pickle.loads(b)) for p, b in zip(own["part"], own["model"])]
        grown = [x for p, x in loaded if p >= 0]
        network = next((x for p, x in loaded if p < 0), None)
        scores = forest_scores([t for _, t in grown], grown[0][0] if grown else 0, _matrix(pdf["if_x"]))
        return pd.DataFrame({"equipment_id": pdf["equipment_id"], "rn": pdf["rn"], "forest": scores, "pred": predict(network, _matrix(pdf["mlp_x"]))})

    return dealt.groupBy("equipment_id", "shard").cogroup(models.groupBy("equipment_id", "shard")).applyInPandas(run, "equipment_id string, rn int, forest double, pred double")
