r"""Bottom-k sketches of documents' shingle hashes: mergeable fingerprints that estimate likeness, containment and size.

A document's set is its distinct shingles of five words (`[^\x20\x09-\x0D]+`, A-Z lower-cased; the whole sequence where there
are fewer). Its fingerprint holds the K smallest 64-bit hashes of the set in order, as base64, so fingerprints of equal sets are
equal, and the fingerprint of a union is the K smallest of both (merge()). With fewer than K hashes it is the whole set and all
estimates are exact; else the K-th smallest tells the number of shingles, and the part of the union's K smallest that
both sides hold tells the resemblance, with a standard error of at most 1 / (2 sqrt(K)), 0.045.

with_heads() gives each row what follows it in an order over all rows without gathering them: rows are dealt to parts by
ranges of doc_id (a doc_id that fills several ranges by hashes of its texts), each part gets a copy of the first row of the
next part, and tasks stream through sorted parts, two rows at a time. Texts are shuffled once.

Defined cases: a null or empty text has no shingles; two empty fingerprints have likeness 1, an empty one and another 0; null
doc_ids come behind all others; rows that repeat a doc_id are ordered by a hash of their text, then the text; a single row is its own
next; an empty table gives no rows; other columns are not read; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvinlake.llm.common import NO_ID, partitions, table, words

K, SHINGLE = 128, 5
SPACE = 2.0**64
#: Word hashes that a worker keeps.
KEEP_WORDS, KEEP_BYTES = 500_000, 64
#: Merged sketches that a task holds before it passes them on.
HOLD = 100_000


# --- sketches -----------------------------------------------------------------------------------------------------


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEEP_BYTES:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def _factor(place: int) -> np.uint64:
    """An odd factor for each place in a shingle."""
    return np.uint64(pow(0x9E3779B97F4A7C15, place + 1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of h, and the mapping is one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < size:  # a sequence of fewer words is one shingle, other than any longer one
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64))
    h = np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += h[i : i + n] * _factor(i)
    return _mixed(total)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, in order."""
    found = np.unique(hashes)
    return found[:k]


def packed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def fingerprint(text: str | None, k: int = K) -> str:
    return packed(bottom(shingle_hashes(text or ""), k))


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def size_estimate(sketch: np.ndarray, k: int = K) -> float:
    """How many distinct shingles the set has; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1.0) / SPACE)


def estimates(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float, float]:
    """(resemblance, share of a that b contains, share of b that a contains)."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same, same
    union = merge(a, b, k)
    shared = np.intersect1d(a, b, assume_unique=True)
    likeness = float(np.count_nonzero(shared <= union[-1])) / len(union)
    both = likeness * size_estimate(union, k)
    return likeness, min(1.0, both / size_estimate(a, k)), min(1.0, both / size_estimate(b, k))


# --- tables of sketches -------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, n_shingles), the last estimated."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_shingles", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bottom(shingle_hashes(t or ""), k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([packed(s) for s in found], pa.string()), pa.array([size_estimate(s, k) for s in found], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """prints(key, fingerprint) -> (key, fingerprint, n_shingles) of the union of each key's parts. Every task merges what it reads
    first, so a key that holds most rows brings no more than a sketch from each task."""
    kind = prints.schema[key].dataType.simpleString()
    schema = f"key {kind}, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        type_ = None

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), type_), pa.array([packed(s) for s in held.values()], pa.string())], names=["key", "fingerprint"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for name, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = unpacked(f or "")
                held[name] = merge(held[name], s, k) if name in held else s
            if len(held) > HOLD:
                yield emitted()
                held.clear()
        if held:
            yield emitted()

    partial = prints.select(F.col(key).alias("key"), "fingerprint").mapInArrow(run, schema)

    def whole(group: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint64)
        for f in group.column("fingerprint").to_pylist():
            total = merge(total, unpacked(f), k)
        return pa.table({"key": group.column("key")[:1], "fingerprint": pa.array([packed(total)], pa.string()), "n_shingles": pa.array([size_estimate(total, k)])})

    return partial.groupBy("key").applyInArrow(whole, f"{schema}, n_shingles double").withColumnRenamed("key", key)


def compared(pairs: DataFrame, a: str = "fingerprint", b: str = "other_fingerprint", k: int = K) -> DataFrame:
    """pairs with `likeness` and `contained` (share of a's set in b's) of the fingerprints in columns a and b."""

    @F.pandas_udf("likeness double, contained double")
    def estimated(x, y):
        import pandas as pd

        return pd.DataFrame([estimates(unpacked(p), unpacked(q), k)[:2] for p, q in zip(x, y)], columns=["likeness", "contained"])

    both = pairs.withColumn("_estimated", estimated(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return both.select(*pairs.columns, "_estimated.likeness", "_estimated.contained")


# --- each row and the next ----------------------------------------------------------------------------------------

def _parted(docs: DataFrame, n: int) -> DataFrame:
    """docs(doc_id, text) with `part`, one of about n, which ascends in the order of the rows, and `code`, a hash of the text."""
    key = F.coalesce("doc_id", F.lit(NO_ID))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    times = Counter(cuts or [])
    # bounds are longs, buckets are found by doubles; of bounds that are equal as doubles the most frequent is kept
    bounds = dict(sorted((float(b), b) for b in sorted(times, key=lambda b: times[b])))
    rows = docs.withColumns({"code": F.xxhash64("text"), "_key": key, "_at": key.cast("double")})
    if not bounds:
        return rows.select(*docs.columns, "code", F.lit(0).alias("part"))
    bucket = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_at", outputCol="_bucket").transform(rows)
    place = F.lit(0)
    # a doc_id that is a bound more than once fills several parts: its rows go by their hashes
    for i, low in enumerate(bounds.values(), 1):
        if (wide := times[low]) > 1:
            lap = F.least(F.floor((F.col("code").cast("double") / SPACE + 0.5) * wide), F.lit(wide - 1)) + 1
            place = F.when(F.col("_bucket") == i, F.when(F.col("_key") > low, 0).when(F.col("_key") == low, lap).otherwise(n + 1)).otherwise(place)
    part = (len(bounds) - F.col("_bucket")).cast("int") * (n + 2) + place.cast("int")
    return bucket.select(*docs.columns, "code", part.alias("part"))


def _order() -> list[Column]:
    return [F.desc_nulls_last("doc_id"), F.col("code"), F.col("text").asc_nulls_first()]


def with_heads(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt to parts and sorted: (part, last, doc_id, text). Behind the rows of each part (last = 0)
    stands the row that follows them (last = 1), the first of all behind the last of all."""
    n = partitions(docs.sparkSession)
    rows = _parted(docs, 2 * n)
    # the first row of each part, by its place; at most as many as parts
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), "code")
    first = rows.groupBy("part").agg(F.min(place).alias("place"))
    heads = rows.select("part", "doc_id", "code", "text", place.alias("place")).join(F.broadcast(first), ["part", "place"]).groupBy("part", "doc_id", "code").agg(F.min("text").alias("text"))
    known = first.select("part")
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # a row a part
    before = known.select("part", F.lag("part").over(order).alias("before"), F.max("part").over(Window.partitionBy(F.lit(0))).alias("end"))
    moved = heads.join(F.broadcast(before), "part").select(F.coalesce("before", "end").alias("part"), F.lit(1).alias("last"), "doc_id", "code", "text")
    both = rows.select("part", F.lit(0).alias("last"), "doc_id", "code", "text").unionByName(moved)
    return both.repartition(n, "part").sortWithinPartitions("part", "last", *_order()).select("last", "doc_id", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_trial(docs: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> each document's fingerprint, that of its edited text, and how near both and the next are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        out: list[tuple] = []

        def shown() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
            out.clear()
            return batch

        for batch in batches:
            for last, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                sketch = bottom(shingle_hashes(text), k)
                if now is not None:
                    own_id, own, own_sketch = now
                    new = edited(own, text)
                    new_sketch = bottom(shingle_hashes(new), k)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), sha, packed(own_sketch), packed(new_sketch), estimates(own_sketch, new_sketch, k)[0], estimates(own_sketch, sketch, k)[0]))
                now = None if last else (doc_id, text, sketch)
            if out:
                yield shown()

    rows = with_heads(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: The part of op13 that SQL can express.
EDITS_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS f FROM d WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(f, length(t) // 2)) AS edited_sha256 FROM n"""


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_trial(table(spark, sf_dir, "documents"))
