r"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct word shingles (words [^\x20\x09-\x0D]+, A-Z lower-cased). Texts with equal sets
form a class, and one document of each class goes on. Each tree starts from all documents and branches recursively: a node
picks one minwise position (and with chance 1/4 a second, so 1.25 = 1 / 0.8 on average) by a hash of its path, and
documents with equal minwise values there meet in a child. Nodes of LEAF documents or fewer are compared
exhaustively, larger ones branch again, and TREES independent trees bring the chance to miss a pair at 0.8 below one in
a million.

Large groups of near copies do not become pairs. Every node first compares its members with the one that has the most
support, and later comparisons are made only in nodes that still hold several components. Nodes of PAIRED documents or
fewer become pairs, confirmed on full sets. Larger ones bring the full sets of their members together, count all
intersections there, and give back a spanning forest of their links, so fewer rows than members. Nodes above LEAF after
DEPTH branchings are compared in blocks: those of the largest component meet only blocks of the other members, which
also meet one another, so no link depends on a cap and an outlier among many copies costs one pass over them. Before sets are built,
documents that share fewer than SHARED nodes with anyone are put aside (a pair at 0.8 shares about 16 of 20).

Classes are known by a hash of their set, not by a doc_id. Defined cases: a text without words, or null, has 0 shingles
and no links; fewer words than a shingle make one shingle; rows with the same doc_id are compared like others and carry
the id as it is; a null doc_id takes part like any other, also as a bridge, but never names a component and is not kept
(of a component without any doc_id the component is null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, drop, join_keys, table, words
from kelvinlake.llm.graph import connected_components

WIDTH, TREES, PAIRED, LEAF, DEPTH, SHARED, SEEN = 64, 16, 32, 1024, 3, 4, 0.5
#: Shingles of all members of a node that meet in one task; FREQUENT: from so many holders on, a shingle is counted by matrix.
LEAF_SHINGLES, FREQUENT, COLUMNS = 4_000_000, 16, 4096
SHINGLE, PERCENT = 5, 80
#: Stands in for a null doc_id where the least one is sought; above every id in use.
LAST_ID = 2**63 - 1
_KEEP = 500_000
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    if len(_known) > _KEEP:
        _known.clear()
    _known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(ws).difference(_known))
    return np.fromiter(map(_known.__getitem__, ws), np.uint64, len(ws))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    ws = words(text or "")
    if not ws:
        return np.zeros(0, np.uint64)
    h, k = word_hashes(ws), min(k, len(ws))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    low = np.full(WIDTH, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at : at + 4096, None] * MULTIPLIERS + OFFSETS).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, s1, s2, sig): s1 and s2 tell the sets apart, sig holds the minwise values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                x = shingle_set(text, k)
                two = mix(x ^ np.uint64(0x5851F42D4C957F2D))
                rows.append((len(x), int(x.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64)), minwise(x).tobytes() if len(x) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "sig"])
            yield out.assign(doc_id=pdf["doc_id"].values, text_key=pdf["text_key"].values)[["doc_id", "text_key", "n_shingles", "s1", "s2", "sig"]]

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInPandas(run, "doc_id long, text_key long, n_shingles long, s1 long, s2 long, sig binary")


def children(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two child paths for each row (path, minwise values), and whether the node has the second."""
    row, out = np.arange(len(paths)), []
    for salt in (1, 2):
        at = mix(paths + np.uint64(salt)) % np.uint64(WIDTH)
        value = sigs[row, at.astype(np.int64)].astype(np.uint64)
        out.append(mix(mix(paths + np.uint64(salt)) ^ (value * np.uint64(0x9E3779B97F4A7C15))))
    return np.stack(out, 1), mix(paths + np.uint64(3)) % np.uint64(4) == 0


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(len(column), WIDTH)


def root_children(sig: str) -> Column:
    def run(column: pd.Series) -> pd.Series:
        sigs, each = _sigs(column), [[] for _ in range(len(column))]
        for tree in range(TREES):
            paths = np.full(len(sigs), mix(np.uint64([tree * 1000 + 17]))[0])
            two, second = children(paths, sigs)
            for i, (a, b) in enumerate(two.view(np.int64).tolist()):
                each[i] += [a, b] if second[i] else [a]
        return pd.Series(each)

    return F.pandas_udf(run, "array<long>")(sig)


def node_children(path: str, sig: str) -> Column:
    def run(paths: pd.Series, column: pd.Series) -> pd.Series:
        two, second = children(paths.to_numpy().astype(np.int64).view(np.uint64), _sigs(column))
        return pd.Series([[a, b] if s else [a] for (a, b), s in zip(two.view(np.int64).tolist(), second)])

    return F.pandas_udf(run, "array<long>")(path, sig)


def equal_values(a: str, b: str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_sigs(x) == _sigs(y)).sum(1)) if len(x) else pd.Series([], dtype="int64")

    return F.pandas_udf(run, "long")(a, b)


def packed(shingles: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def common_shingles(a: str, b: str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(unpacked(p), unpacked(q))) for p, q in zip(x, y)], dtype="int64")

    return F.pandas_udf(run, "long")(a, b)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets (above the diagonal): rare shingles pair by pair, others by matrix products."""
    n = len(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in sets])
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    _, number, holders = np.unique(shingle, return_inverse=True, return_counts=True)
    rare = (holders < FREQUENT)[number]
    out = np.zeros(n * n, np.int64)
    what, who = number[rare], owner[rare].astype(np.int64)
    for step in range(1, FREQUENT - 1):
        met = what[step:] == what[:-step]
        if not met.any():
            break
        out += np.bincount(who[:-step][met] * n + who[step:][met], minlength=n * n)
    column = np.cumsum(holders >= FREQUENT)[number[~rare]] - 1
    who, cuts = owner[~rare], np.arange(0, int((holders >= FREQUENT).sum()) + COLUMNS, COLUMNS)
    edges, out = np.searchsorted(column, cuts), out.reshape(n, n)
    for lo, hi, first in zip(edges[:-1], edges[1:], cuts):
        held = np.zeros((n, COLUMNS), np.float32)
        held[who[lo:hi], column[lo:hi] - first] = 1
        out += np.rint(held @ held.T).astype(np.int64)
    return np.triu(out, 1)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    fresh, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        queue = [root] if fresh[root] else []
        fresh[root] = False
        while queue:
            at = queue.pop()
            found = np.flatnonzero(linked[at] & fresh).tolist()
            fresh[found] = False
            out += [(at, x) for x in found]
            queue += found
    return out


def node_links(percent: int):
    """For members (rep, comp, shingles) of a node or of two of its blocks: enough links (a, b) to connect what is linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [unpacked(x) for x in pdf["shingles"]]
        size, comp, rep = np.array([len(x) for x in sets]), pdf["comp"].to_numpy(), pdf["rep"].to_numpy()
        same = intersections(sets)
        linked = (100 * same >= percent * (size[:, None] + size - same)) & (comp[:, None] != comp)
        edges = np.array(forest(linked | linked.T), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": rep[edges].min(1), "b": rep[edges].max(1)})

    return run


CLASS = ["n_shingles", "s1", "s2"]


class _Join:
    """The state of one join: class representatives, their sets and the links found so far."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.sketches = cut(sketch_documents(docs, k), "sketches")
        grouped = self.sketches.filter("n_shingles > 0").groupBy(*CLASS)
        # rep: the class as a node; its text is found by the least (doc_id, text), a null id standing last
        one = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text_key")).alias("one")
        classes = grouped.agg(one, F.max("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
        self.classes = cut(classes.select(*CLASS, F.xxhash64(*CLASS).alias("rep"), "one.*", "sig", "copies"), "classes")
        self.reps = self.classes.select("rep", F.col("n_shingles").alias("n"), "sig")
        # the stars of the components so far, and links found since
        self.stars_now: DataFrame | None = None
        self.links: list[DataFrame] = []

    def suspects(self) -> DataFrame:
        """(key, rep, support) at depth 1 for the documents that share enough nodes with others.

        support sums the sizes of a document's nodes. An original holds the values most of its copies hold, so it has
        the most support among them.
        """
        rows = cut(self.reps.select("rep", F.explode(root_children("sig")).alias("key")), "nodes")
        met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = join_keys(rows, met, ["key"], "n", rows.count())
        enough = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("support")).filter(F.col("times") >= SHARED)
        return cut(shared.select("key", "rep").join(enough.select("rep", "support"), "rep"), "suspects")

    def build_sets(self, nodes: DataFrame) -> None:
        k = self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for pdf in batches:
                new = pdf[~pdf["rep"].isin(seen)].drop_duplicates("rep")
                seen.update(new["rep"].tolist())
                yield pd.DataFrame({"rep": new["rep"], "shingles": [packed(shingle_set(t, k)) for t in new["text"]]})

        wanted = self.classes.join(nodes.select("rep").distinct(), "rep", "left_semi").select("id", "text_key", "rep")
        texts = self.docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("text_key"), "text")
        # rows that repeat both id and text give a set for each task at most, and one of them is kept
        found = texts.join(wanted, ["id", "text_key"]).select("rep", "text").mapInPandas(run, "rep long, shingles binary")
        self.sets = cut(found.groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")

    def components(self) -> DataFrame:
        """(node, component) of all links so far. Components known before go in as stars, not as the links they came from."""
        if self.links:
            edges = reduce(DataFrame.unionByName, self.links)
            if self.stars_now is not None:
                edges = edges.unionByName(self.stars_now.select(F.col("component").alias("a"), F.col("node").alias("b")))
            self.stars_now, self.links = cut(connected_components(edges), "components"), []
        return self.stars_now

    def placed(self, nodes: DataFrame, components: DataFrame | None) -> DataFrame:
        """nodes with the component of each document."""
        if components is None:
            return nodes.withColumn("comp", F.col("rep"))
        return nodes.join(components, nodes["rep"] == components["node"], "left").select("key", "rep", "support", F.coalesce("component", "rep").alias("comp"))

    def confirm(self, pairs: DataFrame) -> None:
        """Add those of pairs(a, b) that are links."""
        p, reps = self.percent, self.reps
        side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
        near = near.filter(100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
        near = near.filter(equal_values("sig_a", "sig_b") >= int(SEEN * WIDTH)).select("a", "b", "n_a", "n_b")
        near = cut(near, "near")
        full = lambda x: self.sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = near.join(full("a"), "a").join(full("b"), "b")
        same = both.withColumn("same", common_shingles("set_a", "set_b"))
        self.add(same.filter(100 * F.col("same") >= p * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b"))
        drop(near)

    def add(self, links: DataFrame) -> None:
        links = cut(links, "links")
        if self.stars_now is None or not links.isEmpty():
            self.links.append(links)

    @staticmethod
    def mixed(at: DataFrame, pivot: Column) -> DataFrame:
        """Nodes that hold several components: (key, n, pivot struct of rep and comp), the pivot with the largest order."""
        return at.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct(pivot.alias("order"), (-F.col("rep")).alias("tie"), "rep", "comp")).alias("pivot")
        ).filter("lo < hi").select("key", "n", F.col("pivot.rep").alias("pivot"), F.col("pivot.comp").alias("pivot_comp"))

    def stars(self, at: DataFrame, pivot: Column) -> DataFrame:
        """Pairs of each mixed node's pivot with the members of other components."""
        return join_keys(at, self.mixed(at, pivot), ["key"], "n", at.count()).filter("comp <> pivot_comp").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))

    def run(self) -> DataFrame:
        nodes = self.suspects()
        self.build_sets(nodes)
        self.confirm(self.stars(self.placed(nodes, None), F.col("support")))
        components = self.components()
        small, whole, depth = [], [], 1
        while True:
            at = self.placed(nodes, components)
            members = cut(join_keys(at, self.mixed(at, F.col("support")).select("key", "n"), ["key"], "n", nodes.count()), "members")
            small.append(members.filter(F.col("n") <= PAIRED))
            large = members.filter(F.col("n") > LEAF)
            rest = depth < DEPTH and bool(large.limit(1).count())
            whole.append(members.filter(F.col("n") > PAIRED).filter(F.col("n") <= LEAF) if rest else members.filter(F.col("n") > PAIRED))
            if not rest:
                break
            below = large.join(self.reps.select("rep", "sig"), "rep").select("rep", "support", F.explode(node_children("key", "sig")).alias("key"))
            nodes, depth = cut(below.select("key", "rep", "support"), "nodes"), depth + 1
        self.add(self.within(reduce(DataFrame.unionByName, whole)))
        # what the larger nodes have joined needs no pairs any more
        components = self.components()
        at = self.placed(reduce(DataFrame.unionByName, small).drop("comp"), components)
        self.confirm(self.exhaustive(at.join(self.mixed(at, F.col("support")).select("key"), "key")))
        return self.components()

    def within(self, members: DataFrame) -> DataFrame:
        """Links in the nodes of members(key, n, rep, comp). A node with too many documents or shingles for one task is
        dealt into blocks of its largest component and blocks of the others; every two of the latter meet, and each
        of them meets every one of the former, whose own links are known."""
        sized = cut(members.select("key", "rep", "comp").join(self.reps.select("rep", F.col("n").alias("size")), "rep"), "sized")
        total = sized.count()
        own = sized.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
        blocks = lambda n, shingles: F.greatest(F.ceil(2 * n / LEAF), F.ceil(2 * shingles / LEAF_SHINGLES), F.lit(1))
        nodes = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "shingles", "comp")).alias("main"))
        single = (F.col("n") <= LEAF) & (F.col("shingles") <= LEAF_SHINGLES)
        others = blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles"))
        nodes = nodes.select("key", "n", F.col("main.comp").alias("main"), F.when(single, 1).otherwise(others).alias("others"), F.when(single, 0).otherwise(blocks(F.col("main.n"), F.col("main.shingles"))).alias("mains"))
        dealt = join_keys(sized, nodes, ["key"], "n", total)
        # blocks from 0 on hold the others (or all members, where one block is enough), those behind them the main component
        main = (F.col("comp") == F.col("main")) & (F.col("mains") > 0)
        place = F.xxhash64("rep", "key")
        dealt = dealt.withColumn("block", F.when(main, F.col("others") + F.pmod(place, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(place, F.col("others"))))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        meets = F.when(F.col("mains") == 0, F.array(F.lit(0).cast("long"))).when(main, upto(F.col("others"))).otherwise(F.filter(upto(F.col("others") + F.col("mains")), lambda x: x != F.col("block")))
        met = dealt.select("key", "rep", "comp", "block", F.explode(meets).alias("other")).select("key", "rep", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return met.join(self.sets, "rep").groupBy("key", "i", "j").applyInPandas(node_links(self.percent), "a long, b long").distinct()

    @staticmethod
    def exhaustive(members: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of a node that are in different components."""
        x, y = (members.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "comp"))) for side in ("a", "b"))
        on = (x["key"] == y["key"]) & (F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b"))
        return x.join(y, on).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def clustered(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, n_shingles, component_id, first_key), a row for each row. first_key is the
    text_key of the least (doc_id, text_key) of the component, whose row stays where one row is to stay."""
    join = _Join(docs, shingle, percent)
    components = join.run()
    grouped = join.classes.join(components, join.classes["rep"] == components["node"], "left").select(*CLASS, "copies", "id", "text_key", F.coalesce("component", "rep").alias("group"))
    grouped = cut(grouped, "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct("id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    named = join_keys(grouped, first, ["group"], "n", grouped.count())
    named = named.select(*CLASS, "copies", F.nullif(F.col("first.id"), F.lit(LAST_ID)).alias("component_id"), F.col("first.text_key").alias("first_key"))
    rows = join.sketches.select("doc_id", "text_key", *CLASS)
    with_words = join_keys(rows.filter("n_shingles > 0"), named, CLASS, "copies", rows.count())
    # rows without words stand for themselves
    alone = rows.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "first_key": F.col("text_key")})
    columns = ["doc_id", "text_key", "n_shingles", "component_id", "first_key"]
    return with_words.select(*columns).unionByName(alone.select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return clustered(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", kept)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op2_sql(shingle: int = 4, percent: int = PERCENT) -> str:
    """DuckDB SQL for op2_near_dedup(): all pairs that share a shingle, then what each document reaches."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(list_slice(w, i, i + {shingle - 1}), ' '))) END AS s FROM w),
e AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM s)),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM same JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= {percent} * (len(p.s) + len(q.s) - n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON doc_id = a
"""
