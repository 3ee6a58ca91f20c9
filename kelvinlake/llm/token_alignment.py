r"""Alignment of the ids of two tokenizers, and how often corpus-wide each pair of ids is linked.

Byte offsets where tokens of both tokenizers end cut a document into groups; all tokens of a group are linked. Neither
tokenizer has a token that holds a blank after something else, so words (cut before single blanks) are encoded and aligned
once a distinct word; words whose pieces do not give their bytes back send the document to whole-text alignment.

Counting is by id-striped dense matrices: side A's ids are dealt to STRIPES stripes by remainder, a stripe is a block of
(its ids x side B's ids). Tasks of the first pass emit, for each chunk of documents and each stripe, the distinct linked
pairs of each document, sorted; then pre-aggregated counts of pairs go to their stripe, are added into its block with
np.add.at, and come out as the pairs that occur. Those and the links meet by stripe: the block is filled again, row maxima
tell each A id's best count, and every link is looked up where it lies. Sums go back by chunk. Nothing is held but one
block (ids of B x ids of A / STRIPES), and one chunk of documents. Stripes are salted where there are more tasks than
stripes, so more tasks share the links of a stripe; blocks are copied to them, links are not.

Defined cases: null and empty texts, and texts that one side's tokens do not give back, have no tokens: zeros and an
empty groups_sha256; special tokens' strings in texts are plain text; repeated rows and repeated or null doc_ids are documents of
their own, in the counts too; texts of any length are aligned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, partitions, table
from kelvinlake.llm.packing import encoder

SIDE_A, SIDE_B = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
IDS_A, IDS_B = 50_257, 32_000
STRIPES = 128
ROWS = -(-IDS_A // STRIPES)
#: A chunk of documents ends at either.
CHUNK_CHARS, CHUNK_DOCS = 2_000_000, 4096
#: Words that a worker keeps from one chunk to the next.
KEEP_WORDS, KEEP_CHARS = 200_000, 30_000_000
#: Partial counts that a task holds before it passes them on.
HOLD = 4_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")


def striped(a: np.ndarray) -> np.ndarray:
    """A's ids in an order in which those of a stripe lie together."""
    return a % STRIPES * ROWS + a // STRIPES


def unstriped(place: np.ndarray) -> np.ndarray:
    return place % ROWS * STRIPES + place // ROWS


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    by = np.argsort(keys, kind="stable")
    keys, values = keys[by], values[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the sizes, one behind another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a = encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.max_token_value + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # an id with what stands behind it: of A within and at the end of a group, of B within a group, at its end, and at the last end
        na, nb = len(self.bytes_a), len(self.bytes_b)
        self.shown = [f"{i}{end}" for n, end in ((na, ","), (na, "|"), (nb, ","), (nb, ";"), (nb, "")) for i in range(n)]
        self.shown_b = 2 * na

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """A's ids of blank + text, B's of text, and whether both give the bytes back."""
        a = [self.a.encode_ordinary(" " + t) for t in texts]
        b = self.b.encode(texts, num_threads=1) if texts else []
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        whole = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
        good = [w == b"".join(map(of_a, x)) and w == b"".join(map(of_b, y)) for w, x, y in zip(whole, a, b)]
        return a, b, np.array(good, bool)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: (n_a, n_b, n_groups, n_links; n_a is -1 where a side does not give the bytes back), its groups as a string,
        how many distinct links it has; and the links of all texts, one behind another, as (striped place of A x IDS_B + B, times)."""
        a, b, good = self.encode(texts)
        a, b = [x if g else [] for x, g in zip(a, good)], [x if g else [] for x, g in zip(b, good)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
        ids_a, ids_b = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        facts = np.stack([np.where(good, n_a, -1), n_b, np.zeros_like(n_a), np.zeros_like(n_a)], axis=1)
        if not len(ids_a):
            none = np.zeros(0, np.int64)
            return facts, [""] * len(texts), np.zeros(len(texts), np.int64), none, none
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        last_a, last_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        text_of = np.repeat(np.arange(len(texts)), n_a)[last_a]  # of each group
        facts[:, 2] = np.bincount(text_of, minlength=len(texts))
        np.add.at(facts[:, 3], text_of, in_a * in_b)
        # ids in order, A's of a group before B's
        final = np.zeros(len(ids_b), bool)
        final[(np.cumsum(n_b) - 1)[n_b > 0]] = True
        code = np.r_[ids_a + last_a * len(self.bytes_a), self.shown_b + ids_b + (last_b.astype(np.int64) + final) * len(self.bytes_b)]
        parts = list(map(self.shown.__getitem__, code[np.argsort(np.r_[group_a * 2, group_b * 2 + 1], kind="stable")].tolist()))
        upto = np.cumsum(n_a + n_b).tolist()
        shown = ["".join(parts[lo:hi]) for lo, hi in zip([0, *upto[:-1]], upto)]
        return facts, shown, *self._links(ids_a, ids_b, in_a, in_b, text_of, len(texts))

    def _links(self, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        place = striped(ids_a)
        space = STRIPES * ROWS * IDS_B
        large = in_a * in_b > 65_536  # these by their distinct ids
        size = np.where(large, 0, in_a * in_b)
        at = ragged(np.zeros_like(size), size)
        wide = np.repeat(in_b, size)
        keys = [np.repeat(text_of, size) * space + place[np.repeat(from_a, size) + at // wide] * IDS_B + ids_b[np.repeat(from_b, size) + at % wide]]
        times = [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(large).tolist():
            ua, na = np.unique(place[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            ub, nb = np.unique(ids_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            keys.append((text_of[g] * space + ua[:, None] * IDS_B + ub[None, :]).ravel())
            times.append((na[:, None] * nb[None, :]).ravel())
        keys, times = summed(np.concatenate(keys), np.concatenate(times))
        return np.bincount(keys // space, minlength=n), keys % space, times


class Words:
    """Distinct words by number, with the facts, groups and links of each; whole texts that words can't align have numbers too."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.reset()

    def reset(self) -> None:
        none = np.zeros(0, np.int64)
        self.number: dict[str, int] = {}
        self.facts, self.shown = np.zeros((0, 4), np.int64), []
        self.first, self.width, self.codes, self.times = none, none, none, none
        self.chars = 0

    def add(self, texts: list[str]) -> None:
        """Numbers for texts, ascending from those given."""
        facts, shown, width, codes, times = self.aligner.align(texts)
        self.first = np.r_[self.first, len(self.codes) + np.cumsum(width) - width]
        self.width, self.codes, self.times = np.r_[self.width, width], np.r_[self.codes, codes], np.r_[self.times, times]
        self.facts = np.concatenate([self.facts, facts])
        self.shown += shown
        self.chars += sum(map(len, texts)) + sum(map(len, shown))

    def of(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's words."""
        cut = [pieces(t) for t in texts]
        fresh = list(set().union(*cut).difference(self.number))
        self.number.update(zip(fresh, range(len(self.shown), len(self.shown) + len(fresh))))
        self.add(fresh)
        numbers = [list(map(self.number.__getitem__, parts)) for parts in cut]
        bad = set(np.flatnonzero(self.facts[:, 0] < 0).tolist())
        if bad:  # the whole text decides
            odd = [k for k, ns in enumerate(numbers) if not bad.isdisjoint(ns)]
            for i, k in enumerate(odd, len(self.shown)):
                numbers[k] = [i]
            self.add([texts[k] for k in odd])
        return numbers


def pieces(text: str) -> list[str]:
    """The words of blank + text, each without its first blank; empty for an empty text."""
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts or any(p[-1].isspace() or p[0].isspace() for p in set(parts)):
        parts = _CUT.split(" " + text)
        parts[0] = parts[0][1:]
    return parts


@functools.cache
def words(path_a: str, path_b: str) -> Words:
    return Words(Aligner(path_a, path_b))


_FACT = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string())])
#: Of a chunk: one row with facts (stripe -1), and for each stripe its links as pair (within the stripe), document, times.
_LINKS = pa.schema([("chunk", pa.int64()), ("stripe", pa.int32()), ("pair", pa.list_(pa.int32())), ("doc", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("facts", pa.list_(_FACT))])
_LINKS_SQL = "chunk long, stripe int, pair array<int>, doc array<int>, times array<long>, facts array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string>>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _chunk(number: int, ids: list, texts: list[str | None], known: Words) -> Iterator[pa.RecordBatch]:
    if len(known.shown) > KEEP_WORDS or known.chars > KEEP_CHARS:
        known.reset()
    numbers = known.of([t or "" for t in texts])
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.fromiter((n for ns in numbers for n in ns), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    facts = np.maximum(known.facts, 0)
    sums = np.zeros((len(texts), 4), np.int64)
    if len(flat):
        full = np.flatnonzero(sizes)
        sums[full] = np.add.reduceat(facts[flat], (np.cumsum(sizes) - sizes)[full], axis=0)
    text_of = known.shown.__getitem__
    shas = [hashlib.sha256(";".join(map(text_of, ns)).encode()).hexdigest() if total else "" for ns, total in zip(numbers, sums[:, 0].tolist())]
    rows = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"), (i, *s, sha))) for i, s, sha in zip(ids, sums.tolist(), shas)]
    yield pa.RecordBatch.from_pylist([{"chunk": number, "stripe": -1, "facts": rows}], _LINKS)
    # words of each document, then links of each word
    n = max(1, len(known.shown))
    keys, times = np.unique(doc * n + flat, return_counts=True)
    doc, word = keys // n, keys % n
    many = known.width[word]
    if not many.sum():
        return
    at = ragged(known.first[word], many)
    links, total = summed(known.codes[at] * len(texts) + np.repeat(doc, many), known.times[at] * np.repeat(times, many))
    doc, code = (links % len(texts)).astype(np.int32), links // len(texts)
    stripe = code // (ROWS * IDS_B)
    there, first = np.unique(stripe, return_index=True)
    bounds = np.r_[first, len(stripe)]
    pair = (code - stripe * (ROWS * IDS_B)).astype(np.int32)
    k = len(there)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, number), pa.int64()), pa.array(there, pa.int32()), _lists(pair, bounds, pa.int32()), _lists(doc, bounds, pa.int32()), _lists(total, bounds, pa.int64()), pa.nulls(k, pa.list_(_FACT))],
        schema=_LINKS,
    )


def document_links(docs: DataFrame, path_a: str = SIDE_A, path_b: str = SIDE_B) -> DataFrame:
    """docs(doc_id, text) -> a row with facts for each chunk of documents, and a row for each stripe of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = words(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
                if chars >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield from _chunk(number, ids, texts, known)
                    number, ids, texts, chars = number + 1, [], [], 0
        if ids:
            yield from _chunk(number, ids, texts, known)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _LINKS_SQL)


_COUNTS = pa.schema([("stripe", pa.int32()), ("pair", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
_COUNTS_SQL = "stripe int, pair array<int>, n array<long>"


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of chunks -> partial counts of documents for each pair."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {s: summed(np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])) for s, parts in held.items()}

    def emitted() -> Iterator[pa.RecordBatch]:
        for s, (p, n) in merged().items():
            yield pa.RecordBatch.from_pylist([{"stripe": s, "pair": p, "n": n}], _COUNTS)

    for batch in batches:
        for stripe, pair in zip(batch.column(0).to_pylist(), batch.column(1)):
            p = pair.values.to_numpy()  # sorted; one entry a document
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            held.setdefault(stripe, []).append((p[first], np.diff(np.r_[first, len(p)]).astype(np.int64)))
            size += len(first)
            if size > HOLD:
                held = {s: [x] for s, x in merged().items()}
                size = sum(len(x[0][0]) for x in held.values())
                if size > HOLD // 2:
                    yield from emitted()
                    held, size = {}, 0
    if held:
        yield from emitted()


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i) for i in range(batch.num_columns)))


def _block_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts in order of their stripes -> counts."""
    now, block = None, None

    def emitted() -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(block)
        for at in range(0, len(there), 500_000):
            some = there[at : at + 500_000]
            yield pa.RecordBatch.from_pylist([{"stripe": now, "pair": some.astype(np.int32), "n": block[some]}], _COUNTS)

    for stripe, pair, n in _stripes(batches):
        if stripe.as_py() != now:
            if now is not None:
                yield from emitted()
            now, block = stripe.as_py(), np.zeros(ROWS * IDS_B, np.int64)
        np.add.at(block, pair.values.to_numpy(), n.values.to_numpy())
    if now is not None:
        yield from emitted()


def pair_counts(links: DataFrame) -> DataFrame:
    """(stripe, pair, n) of document_links() as a table: the documents that hold each pair linked."""
    n = partitions(links.sparkSession)
    partial = links.filter("stripe >= 0").select("stripe", "pair").mapInArrow(_count_task, _COUNTS_SQL)
    return partial.repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(_block_task, _COUNTS_SQL)


def translations(counts: DataFrame) -> DataFrame:
    """pair_counts() as (a, b, documents, best): best where no other b of a is linked in more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, pair, n in _stripes(batches):
            place = pair.values.to_numpy().astype(np.int64) + stripe.as_py() * ROWS * IDS_B
            yield pa.RecordBatch.from_arrays([pa.array(unstriped(place // IDS_B), pa.int32()), pa.array((place % IDS_B).astype(np.int32)), n.values], names=["a", "b", "documents"])

    flat = counts.mapInArrow(run, "a int, b int, documents long")
    most = flat.groupBy("a").agg(F.max("documents").alias("most"))
    return flat.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


_SCORES = pa.schema([("chunk", pa.int64()), ("doc", pa.list_(pa.int32())), ("best", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])


def _score_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stripe its counts, then its links -> sums for the documents of each chunk."""
    now, block, top = None, None, None
    for stripe, salt, chunk, pair, doc, times in _stripes(batches):
        if (stripe, salt) != now:
            now, block, top = (stripe, salt), np.zeros(ROWS * IDS_B, np.int64), None
        p, t = pair.values.to_numpy(), times.values.to_numpy()
        if chunk.as_py() is None:
            np.add.at(block, p, t)
            continue
        if top is None:
            top = block.reshape(ROWS, IDS_B).max(axis=1)
        n, d = block[p], doc.values.to_numpy()
        best = np.where(n == top[p // IDS_B], t, 0)
        there, at = np.unique(d, return_inverse=True)
        sums = np.zeros((2, len(there)), np.int64)
        np.add.at(sums[0], at, best)
        np.add.at(sums[1], at, t * n)
        yield pa.RecordBatch.from_pylist([{"chunk": chunk.as_py(), "doc": there, "best": sums[0], "total": sums[1]}], _SCORES)


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _gather_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk its facts, then its sums -> documents."""
    facts, best, total = None, None, None

    def emitted() -> pa.RecordBatch:
        f = facts.flatten()
        return pa.RecordBatch.from_arrays([*f[:5], pa.array(best), pa.array(total), f[5]], schema=_OUT)

    for own, doc, b, t in _stripes(batches):
        if own.is_valid:
            if facts is not None:
                yield emitted()
            facts = own.values
            best, total = np.zeros(len(facts), np.int64), np.zeros(len(facts), np.int64)
        else:
            d = doc.values.to_numpy()
            best[d] += b.values.to_numpy()
            total[d] += t.values.to_numpy()
    if facts is not None:
        yield emitted()


def align(docs: DataFrame, path_a: str = SIDE_A, path_b: str = SIDE_B) -> DataFrame:
    """docs(doc_id, text) -> for each document its tokens, groups and links, how many links are the best of their A id, and the sum
    of their counts."""
    spark = docs.sparkSession
    links = cut(document_links(docs, path_a, path_b), "token-links", "zstd")
    counts = cut(pair_counts(links), "pair-counts", "zstd")
    n = partitions(spark)
    salts = max(1, n // STRIPES)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    a = counts.select("stripe", none("chunk", "long"), "pair", none("doc", "array<int>"), F.col("n").alias("times"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    b = links.filter("stripe >= 0").select("stripe", "chunk", "pair", "doc", "times", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"))
    met = a.unionByName(b).repartition(n, "stripe", "salt").sortWithinPartitions("salt", "stripe", F.col("chunk").asc_nulls_first())
    sums = met.select("stripe", "salt", "chunk", "pair", "doc", "times").mapInArrow(_score_task, "chunk long, doc array<int>, best array<long>, total array<long>")
    heads = links.filter("stripe < 0").select("chunk", "facts", none("doc", "array<int>"), none("best", "array<long>"), none("total", "array<long>"))
    rest = sums.select("chunk", F.lit(None).cast(links.schema["facts"].dataType).alias("facts"), "doc", "best", "total")
    back = heads.unionByName(rest).repartition(n, "chunk").sortWithinPartitions("chunk", F.col("facts").isNull())
    return back.select("facts", "doc", "best", "total").mapInArrow(_gather_task, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
