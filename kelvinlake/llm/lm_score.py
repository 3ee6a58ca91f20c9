r"""LM scoring with a causal self-attention model trained in numpy on subword ids.

Two scores for each document. The base score is an add-one unigram over words [^\x20\x09-\x0D]+ (A-Z lower-cased) and
an end: exact counts over all training documents. Each partition cuts its rows into blocks of about BLOCK_BYTES, whatever
ids they carry, and reads each text once: its words become places among the distinct words of its block. Each block sends these words with
their counts, packed, to as many slices of all words as there are blocks' worth of text; a slice sums the counts and sends each block
back those of its own words with their subword ids, so no table of all words is ever held in one place.

The model's score is over subword ids of the words and an end id. A one-layer attention model reads windows of WINDOW
ids that overlap by OVERLAP; every id is scored once, in the first window that holds it behind enough context. It
predicts the id's class and then, from the same hidden state, the id's leaf within the class: CLASSES x LEAVES leaves, of
which the most frequent ids have one each (over 99 % of all ids in a corpus of a few languages) and the others share the
last of each class by their counts. Attention is batched over windows and masked causally.
Weights are trained once on every id of every training document, in the same windows, each in one of ROUNDS rounds, whatever
the size of the corpus: each partition trains on its own share, and weights are averaged, weighted by windows, after each
round, so they depend on how rows lie in partitions.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2. Defined cases: a null or empty text is its
end alone; a null doc_id is a training document; repeated rows count and are scored like any others; without training
documents all counts are 0 and the classes are uniform; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, drop, table
from kelvinlake.llm.packing import VOCABULARY, encoder

BLOCK_BYTES = 16_000_000
IDS, END = 50257, 50256
BUCKETS, CLASSES, LEAVES, DIM, WINDOW, OVERLAP = 2048, 32, 32, 16, 24, 6
ROUNDS, BATCH, RATE, SPREAD = 2, 128, 0.01, 0.2
#: Documents whose ids are trained on or scored at once, and words whose ids are put together at once.
CHUNK, RUN_WORDS = 256, 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- subword ids -----------------------------------------------------------------------------------------------


def word_ids(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of the words, one behind another, and where each word's begin (and the end)."""
    enc = encoder(VOCABULARY)
    each = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in distinct]
    starts = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=starts[1:])
    return np.fromiter((i for x in each for i in x), np.int64, starts[-1]), starts


def gathered(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of a sequence of words, given by their places."""
    sizes = starts[which + 1] - starts[which]
    first = np.cumsum(sizes) - sizes
    return flat[np.arange(sizes.sum()) + np.repeat(starts[which] - first, sizes)]


# --- the model -------------------------------------------------------------------------------------------------


@functools.cache
def keep_freed_memory() -> None:
    """Let this worker's C library keep up to 64 MB of freed arrays: numpy frees and takes the same few again all the time."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 64 << 20), libc.mallopt(-3, 16 << 20)  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


class Coding:
    """Buckets (input), classes and leaves (output) of the ids, from their counts in the training documents.

    The CLASSES * LEAVES - CLASSES most frequent ids have a class and a leaf of their own, neighbours in the alphabet of subwords
    sharing a class; each class's last leaf is dealt the other ids, which share it by their counts.
    """

    def __init__(self, counts: np.ndarray):
        rank = np.empty(IDS, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(IDS)
        half = BUCKETS // 2
        self.bucket = np.where(rank < half, rank, half + np.arange(IDS) % half).astype(np.uint16)
        own = LEAVES - 1
        enc = encoder(VOCABULARY)
        order = sorted(np.flatnonzero(rank < CLASSES * own).tolist(), key=lambda i: enc.decode_single_token_bytes(i))
        self.cls, self.leaf = (np.arange(IDS) % CLASSES).astype(np.uint8), np.full(IDS, own, np.uint8)
        self.cls[order], self.leaf[order] = np.divmod(np.arange(len(order)), own)
        rest = self.leaf == own
        total = np.bincount(self.cls[rest], counts[rest] + 1.0, CLASSES)
        #: Natural logarithms of what the classes hold, and of their leaves' shares: where the model's output starts.
        mass = np.bincount(self.cls.astype(np.int64) * LEAVES + self.leaf, counts + 0.01, CLASSES * LEAVES).reshape(CLASSES, LEAVES) + 1e-3
        self.start = np.log(mass.sum(1) / mass.sum()), np.log(mass / mass.sum(1, keepdims=True))
        self.within = np.where(rest, np.log10((counts + 1.0) / np.maximum(total[self.cls], 1.0)), 0.0)


def initial(start: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """e, p: embeddings of buckets and places; a: queries, keys and values; o: from context back; c, b: classes; w, l: leaves
    of each class. b and l start from the ids' counts."""
    rng = np.random.default_rng(11)
    shapes = {"e": (BUCKETS, DIM), "p": (WINDOW, DIM), "a": (DIM, 3 * DIM), "o": (DIM, DIM), "c": (DIM, CLASSES), "b": (CLASSES,), "w": (CLASSES, DIM, LEAVES), "l": (CLASSES, LEAVES)}
    m = {n: (rng.normal(0, SPREAD if n not in "bl" else 0, s)).astype(np.float32) for n, s in shapes.items()}
    return m | {"b": start[0].astype(np.float32), "l": start[1].astype(np.float32)}


LOG10_E = np.float32(1 / np.log(10))
PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Attention and output scores are held below this, so their exponentials need no maximum taken off.
BOUND = np.float32(40)
#: Windows whose hidden states are scored together, and rows of a class at a time.
BLOCK, TILE = 4096, 512


def attended(q: np.ndarray, k: np.ndarray, v: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of what each query sees in its window, not yet divided by their sums; the sums; the contexts, by query."""
    a = q @ k.transpose(0, 2, 1)
    if a.max(initial=0) > BOUND:
        np.minimum(a, BOUND, out=a)
    np.exp(a, out=a)
    a *= past
    seen = a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], a.dtype)
    ctx = (a @ v).reshape(-1, DIM)
    ctx /= seen[:, None]
    return a, seen, ctx


def by_row(t: np.ndarray, early: np.ndarray) -> np.ndarray:
    """What t, windows x WINDOW, holds for the rows of hidden()."""
    return np.concatenate([t[:, OVERLAP:].ravel(), t[early, :OVERLAP].ravel()])


def hidden(m: dict[str, np.ndarray], x: np.ndarray, early: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple, tuple, np.ndarray]:
    """x: buckets, windows x WINDOW. Position i predicts what follows x[i] from x[:i + 1]. The first OVERLAP positions of a window are
    context alone, of which nothing but keys and values is needed, but in the windows `early`. Returns embeddings, queries with keys and
    values, attended() of the later positions and of the early ones, and the hidden states, with a 1 at the end of each: a row for each later,
    then each early one."""
    n, k = len(x), len(x) * (WINDOW - OVERLAP)
    h = m["e"].take(x, axis=0)
    h += m["p"]
    qkv = (h.reshape(n * WINDOW, DIM) @ m["a"]).reshape(n, WINDOW, 3 * DIM)
    own = qkv[early, :OVERLAP]
    late, first = (attended(t[:, lo:, :DIM], t[..., DIM : 2 * DIM], t[..., 2 * DIM :], PAST[lo : lo + t.shape[1], : t.shape[1]]) for t, lo in ((qkv, OVERLAP), (own, 0)))
    top = np.empty((k + len(early) * OVERLAP, DIM + 1), h.dtype)
    top[:, DIM] = 1
    for rows, (_, _, ctx), own in ((top[:k], late, h[:, OVERLAP:]), (top[k:], first, h[early, :OVERLAP])):
        np.matmul(ctx, m["o"], out=rows[:, :DIM])
        rows.reshape(-1, own.shape[1], DIM + 1)[..., :DIM] += own
    return h, qkv, late, first, top


def output_weights(m: dict[str, np.ndarray]) -> np.ndarray:
    """For each class the weights of all classes and of its leaves, side by side; below them what is added, for a hidden state that ends in 1."""
    out = np.empty((CLASSES, DIM + 1, CLASSES + LEAVES), m["c"].dtype)
    out[:, :DIM, :CLASSES], out[:, DIM, :CLASSES], out[:, :DIM, CLASSES:], out[:, DIM, CLASSES:] = m["c"], m["b"], m["w"], m["l"]
    return out


def summed(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each row over the classes and over the leaves."""
    return e[:, :CLASSES] @ np.ones(CLASSES, e.dtype), e[:, CLASSES:] @ np.ones(LEAVES, e.dtype)


def grouped(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and where the rows of each class that has any lie in it."""
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
    return np.argsort(cls, kind="stable"), [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *ends], ends)) if hi > lo]


def gradients(m: dict[str, np.ndarray], x: np.ndarray, cls: np.ndarray, leaf: np.ndarray, live: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Of the mean log-loss over the live positions, whose classes and leaves follow. Rows of the output are live ones, in the order of classes."""
    n, late_rows = len(x), len(x) * (WINDOW - OVERLAP)
    early = np.flatnonzero(live[:, :OVERLAP].any(1))
    h, qkv, late, first, states = hidden(m, x, early)
    at = np.flatnonzero(by_row(live, early))
    order, groups = grouped(by_row(cls, early)[at])
    at = at[order]
    k, top, out = len(at), states.take(at, axis=0), output_weights(m)
    z = np.empty((k, CLASSES + LEAVES), states.dtype)
    for c, lo, hi in groups:
        np.matmul(top[lo:hi], out[c], out=z[lo:hi])
    held = z >= BOUND if z.max(initial=0) >= BOUND else None
    if held is not None:
        np.minimum(z, BOUND, out=z)
    flat, row = z.reshape(-1), np.arange(0, z.size, CLASSES + LEAVES)
    right = row + by_row(cls, early)[at], row + CLASSES + by_row(leaf, early)[at]
    chosen = [flat.take(r) for r in right]
    np.exp(z, out=z)
    odds = summed(z)
    share = z.dtype.type(1 / max(1, k))
    loss = -float(sum((c - np.log(o)).sum() for c, o in zip(chosen, odds)) * share)
    for own, o, r in zip((z[:, :CLASSES], z[:, CLASSES:]), odds, right):
        own *= (share / o)[:, None]
        flat[r] -= share
    if held is not None:
        z[held] = 0
    gout, back = np.zeros_like(out), np.empty((k, DIM), z.dtype)
    for c, lo, hi in groups:
        np.matmul(top[lo:hi].T, z[lo:hi], out=gout[c])
        np.matmul(z[lo:hi], out[c, :DIM].T, out=back[lo:hi])
    total = gout[:, :, :CLASSES].sum(0)
    g = {"c": total[:DIM], "b": total[DIM], "w": gout[:, :DIM, CLASSES:], "l": gout[:, DIM, CLASSES:]}
    dtop = np.zeros((len(states), DIM), z.dtype)
    dtop[at] = back
    g["o"] = late[2].T @ dtop[:late_rows] + first[2].T @ dtop[late_rows:]

    def attention(part: tuple, t: np.ndarray, lo: int, d: np.ndarray, dt: np.ndarray) -> None:
        """Into dt: of t, queries with keys and values, where the queries from position lo on were attended()."""
        (a, seen, ctx), q = part, t[:, lo:, :DIM]
        dctx = d @ m["o"].T
        dctx /= seen[:, None]
        away = np.einsum("ij,ij->i", ctx, dctx).reshape(len(q), -1, 1)
        dctx = dctx.reshape(q.shape)
        da = dctx @ t[..., 2 * DIM :].transpose(0, 2, 1)
        da -= away
        da *= a
        dt[:, :lo, :DIM] = 0
        np.matmul(da, t[..., DIM : 2 * DIM], out=dt[:, lo:, :DIM])
        np.matmul(da.transpose(0, 2, 1), q, out=dt[..., DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), dctx, out=dt[..., 2 * DIM :])

    dqkv = np.empty_like(qkv)
    attention(late, qkv, OVERLAP, dtop[:late_rows], dqkv)
    if len(early):
        own = qkv[early, :OVERLAP]
        also = np.empty_like(own)
        attention(first, own, 0, dtop[late_rows:], also)
        dqkv[early, :OVERLAP] += also
    dqkv = dqkv.reshape(n * WINDOW, 3 * DIM)
    g["a"] = h.reshape(n * WINDOW, DIM).T @ dqkv
    dh = (dqkv @ m["a"].T).reshape(n, WINDOW, DIM)
    dh[:, OVERLAP:] += dtop[:late_rows].reshape(n, -1, DIM)
    dh[early, :OVERLAP] += dtop[late_rows:].reshape(-1, OVERLAP, DIM)
    g["p"] = (np.ones(n, dh.dtype) @ dh.reshape(n, WINDOW * DIM)).reshape(WINDOW, DIM)
    order = np.argsort(x.ravel(), kind="stable")
    held = np.bincount(x.ravel(), minlength=BUCKETS)
    some = np.flatnonzero(held)
    begins = (np.cumsum(held) - held)[some]
    g["e"] = np.zeros_like(m["e"])
    g["e"][some] = np.add.reduceat(dh.reshape(n * WINDOW, DIM).take(order, axis=0), begins, axis=0)
    return g, loss


class Adam:
    """Steps of the weights m, all in one array, of which m's become views; STEP of them at a time, so that their moments stay in a cache."""

    STEP = 1 << 13

    def __init__(self, m: dict[str, np.ndarray]):
        self.n, self.all = 0, np.concatenate([v.ravel() for v in m.values()])
        self.names = list(m)
        for k, v in zip(m, np.split(self.all, np.cumsum([v.size for v in m.values()])[:-1])):
            m[k] = v.reshape(m[k].shape)
        self.first, self.second = np.zeros_like(self.all), np.zeros_like(self.all)

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = np.float32(RATE * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n))
        whole = np.concatenate([g[k].ravel() for k in self.names])
        for lo in range(0, whole.size, self.STEP):
            v, t, first, second = (x[lo : lo + self.STEP] for x in (self.all, whole, self.first, self.second))
            by = t - first
            by *= np.float32(0.1)
            first += by
            t *= t
            t -= second
            t *= np.float32(0.001)
            second += t
            np.sqrt(second, out=by)
            by += np.float32(1e-7)
            np.divide(first, by, out=by)
            by *= rate
            v -= by


def windows(sizes: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of these sizes, one behind another: each window's first place, its size, and its scored part's start."""
    stride = WINDOW - overlap
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(1, -(-(sizes - overlap) // stride))
    within = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    start = np.repeat(begins, n) + within
    return start, np.minimum(WINDOW, np.repeat(sizes, n) - within), np.where(within == 0, 0, overlap)


def placed(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each window's positions, and which positions exist (the others stand at its start)."""
    at = np.arange(WINDOW, dtype=np.int64)
    live = at < size[:, None]
    return np.where(live, start[:, None] + at, start[:, None]), live


def preceding(code: Coding, ids: np.ndarray) -> np.ndarray:
    """The bucket of what stands before each id: at a sequence's start the END before it."""
    return np.concatenate([code.bucket[[END]], code.bucket.take(ids[:-1])])


def sequence_scores(m: dict[str, np.ndarray], code: Coding, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence; ids: the sequences, each closed by END, one behind another."""
    given, cls, leaf = preceding(code, ids), code.cls.take(ids), code.leaf.take(ids)
    out = code.within.take(ids)
    start, size, scored = windows(sizes)
    weights = output_weights(m)
    for begin in range(0, len(start), BLOCK):
        states, place = [], []
        for lo in range(begin, min(begin + BLOCK, len(start)), BATCH):
            at, live = placed(start[lo : lo + BATCH], size[lo : lo + BATCH])
            early = np.flatnonzero(scored[lo : lo + BATCH] == 0)
            states.append(hidden(m, given.take(at), early)[-1])
            place.append(np.where(by_row(live, early), by_row(at, early), -1))
        states, place = np.concatenate(states), np.concatenate(place)
        live = np.flatnonzero(place >= 0)
        order, groups = grouped(cls.take(place[live]))
        order = live[order]
        place = place[order]
        right = CLASSES + leaf.take(place).astype(np.int64)
        for c, upto, stop in groups:
            for lo in range(upto, stop, TILE):
                hi = min(lo + TILE, stop)
                z = states.take(order[lo:hi], axis=0) @ weights[c]
                if z.max() > BOUND:
                    np.minimum(z, BOUND, out=z)
                got = z[:, c] + z.reshape(-1).take(np.arange(0, z.size, CLASSES + LEAVES) + right[lo:hi])
                np.exp(z, out=z)
                for odds in summed(z):
                    got -= np.log(odds)
                out[place[lo:hi]] += got * LOG10_E
    return np.add.reduceat(out, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def share(ids: np.ndarray, sizes: np.ndarray, turn: int) -> np.ndarray:
    """Which of the windows(sizes) of these sequences a round learns from: over all rounds every window once, whatever else lies in the chunk."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    start, _, _ = windows(sizes)
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins, start, "right") - 1
    return np.flatnonzero((np.add.reduceat(ids.astype(np.int64), begins)[of] + (start - begins[of]) // (WINDOW - OVERLAP)) % ROUNDS == turn)


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """CHUNK rows of coded() at a time, their ids and how many each has."""
    for pdf in batches:
        for lo in range(0, len(pdf), CHUNK):
            own = pdf.iloc[lo : lo + CHUNK]
            yield own, np.frombuffer(b"".join(own["ids"]), "<u2"), own["ids"].str.len().to_numpy(np.int64) // 2


def train(docs: DataFrame, code: Coding) -> tuple[dict[str, np.ndarray], int]:
    """docs(ids): the training documents, of coded(). The weights, and how many windows they have learned from; a row for each weight and partition meets in a weighted mean."""
    model, seen = initial(code.start), 0
    sizes = {k: v.size for k, v in model.items()}
    known = docs.sparkSession.sparkContext.broadcast(code)
    for turn in range(ROUNDS):
        now = model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep_freed_memory()
            code = known.value
            m = {k: v.copy() for k, v in now.items()}
            adam, done, at = Adam(m), 0, np.arange(WINDOW)
            for _, ids, lens in chunks(batches):
                given, cls, leaf = preceding(code, ids), code.cls.take(ids), code.leaf.take(ids)
                start, size, scored = windows(lens)
                pick = np.random.default_rng(turn * 1_000_003 + len(ids)).permutation(share(ids, lens, turn))
                for lo in range(0, len(pick), BATCH):
                    own = pick[lo : lo + BATCH]
                    place, live = placed(start[own], size[own])
                    live &= at >= scored[own, None]  # what two windows hold is context in the second
                    g, _ = gradients(m, given.take(place), cls.take(place), leaf.take(place), live)
                    adam.step(g)
                done += len(pick)
            if done:
                yield pd.DataFrame({"i": np.arange(sum(sizes.values())), "w": np.concatenate([v.ravel() for v in m.values()]).astype(float), "n": done})

        parts = docs.select("ids").mapInPandas(run, "i int, w double, n long")
        rows = parts.groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"), F.sum("n").alias("n")).toPandas().sort_values("i")
        if rows.empty:
            continue
        seen += int(rows["n"].iloc[0])
        cuts = np.split(rows["w"].to_numpy(np.float32), np.cumsum(list(sizes.values()))[:-1])
        model = {k: c.reshape(v.shape) for c, (k, v) in zip(cuts, model.items())}
    return model, seen


# --- jobs ------------------------------------------------------------------------------------------------------


BLOCKS = "block long, doc_id long, train boolean, seq binary, slice int, words binary, at binary, n binary"


def in_blocks(docs: DataFrame, slices: int) -> DataFrame:
    """docs(doc_id, text) -> BLOCKS: the rows of a partition in blocks of about BLOCK_BYTES, one behind another. Texts are read here alone: a
    row for each document has its words by their places among the distinct words of its block (seq, 32-bit numbers). Those words
    are dealt to slices by a checksum, a row for each block and slice: the words with a blank between, their places (at), and their
    counts in training documents (n; 0 for words of held-out ones alone)."""
    columns = [x.split()[0] for x in BLOCKS.split(", ")]

    def packed(block: int, place: dict[bytes, int], trained: list[np.ndarray]) -> pd.DataFrame:
        n = np.bincount(np.concatenate([np.zeros(0, "<u4"), *trained]), minlength=len(place)).astype("<u4")
        ws = list(place)
        of = np.fromiter((zlib.crc32(w) % slices for w in ws), np.int64, len(ws))
        held, first = np.unique(np.sort(of), return_index=True)
        parts = np.split(np.argsort(of, kind="stable"), first[1:])
        rows = pd.DataFrame({"block": block, "slice": held, "words": [b" ".join([ws[i] for i in x.tolist()]) for x in parts], "at": [x.astype("<u4").tobytes() for x in parts], "n": [n[x].tobytes() for x in parts]})
        return rows.reindex(columns=columns).astype({"doc_id": "Int64", "train": "boolean"})

    def empty() -> dict[bytes, int]:
        place = defaultdict(int)
        place.default_factory = place.__len__  # a new word's place is the number of those before it
        return place

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size, place, trained = TaskContext.get().partitionId() << 24, 0, empty(), []
        for pdf in batches:
            begin, seq = 0, []
            for i, (text, train_doc) in enumerate(zip(pdf["text"], pdf["train"])):
                ws = text.lower().split() if text else []
                at = np.fromiter(map(place.__getitem__, ws), "<u4", len(ws))
                seq.append(at.tobytes())
                if train_doc:
                    trained.append(at)
                size += len(text) if text else 0
                if size >= BLOCK_BYTES or i == len(pdf) - 1:
                    rows = pdf[["doc_id", "train"]].iloc[begin : i + 1].assign(block=block, seq=seq).reindex(columns=columns)
                    yield rows.astype({"slice": "Int32"})
                    begin, seq = i + 1, []
                if size >= BLOCK_BYTES:
                    if place:
                        yield packed(block, place, trained)
                    block, size, place, trained = block + 1, 0, empty(), []
        if place:
            yield packed(block, place, trained)

    train = (~held_out(docs["doc_id"])).alias("train")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), train).mapInPandas(run, BLOCKS)


VOCAB = "block long, at binary, c binary, sizes binary, ids binary, n long, v long"


def slice_vocab(pdf: pd.DataFrame) -> pd.DataFrame:
    """The words of one slice, of in_blocks() -> VOCAB. Each row gets back, for the places of its words (at), their counts over all blocks (c), how many subword ids each
    has (sizes) and those (ids, as 16-bit numbers: IDS is below 2^16). A row without a block sums the slice up: its subword ids with
    their counts in training words (ids, c), its training words (n) and how many differ (v)."""
    place: dict[bytes, int] = {}
    which = [np.array([place.setdefault(w, len(place)) for w in x.split()], np.int64) for x in pdf["words"]]
    c = np.zeros(len(place), np.int64)
    for at, n in zip(which, pdf["n"]):
        c[at] += np.frombuffer(n, "<u4")  # a row's words differ
    flat, starts = word_ids(list(place))
    flat, sizes = flat.astype("<u2"), np.diff(starts)
    total = np.bincount(flat, np.repeat(c, sizes), IDS)
    held = np.flatnonzero(total)
    rows = [(block, x, c[at].astype("<i8").tobytes(), sizes[at].astype("<u4").tobytes(), gathered(flat, starts, at).tobytes(), None, None) for block, x, at in zip(pdf["block"], pdf["at"], which)]
    rows.append((None, None, total[held].astype("<i8").tobytes(), None, held.astype("<u2").tobytes(), int(c.sum()), int((c > 0).sum())))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in VOCAB.split(", ")]).astype({"block": "Int64", "n": "Int64", "v": "Int64"})


def id_counts(sums: DataFrame) -> np.ndarray:
    """Subword ids in the training words, from the rows of VOCAB without a block; at most IDS rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(IDS)
        for pdf in batches:
            for ids, c in zip(pdf["ids"], pdf["c"]):
                total[np.frombuffer(ids, "<u2")] += np.frombuffer(c, "<i8")
        held = np.flatnonzero(total)
        yield pd.DataFrame({"id": held, "n": total[held]})

    out = np.zeros(IDS)
    for r in sums.select("c", "ids").mapInPandas(run, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


CODED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, ids binary"


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows of these sizes in runs of `most` in all, or of one row."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def coded(docs: DataFrame) -> tuple[DataFrame, Coding]:
    """docs(doc_id, text) -> CODED, a row for each row: base score, and the subword ids and END as 16-bit numbers. Training and scoring read these."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = cut(in_blocks(docs, 1 + size // BLOCK_BYTES), "blocks", "zstd")
    rows, pairs = dealt.filter("slice is null").select("block", "doc_id", "train", "seq"), dealt.filter("slice is not null").select("block", "slice", "words", "at", "n")
    n_end = rows.agg(F.count_if("train")).first()[0]
    vocab = cut(pairs.groupBy("slice").applyInPandas(slice_vocab, VOCAB), "vocab", "zstd")
    sums = vocab.filter("block is null")
    seen = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_train, n_types = seen["n"] + n_end, seen["v"] + (n_end > 0)

    ids = id_counts(sums)
    ids[END] += n_end
    floor_ = np.log10(n_train + n_types + 1.0)

    def run(pdf: pd.DataFrame, vocab: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({x.split()[0]: [] for x in CODED.split(", ")})
        at, c, sizes, flat = (np.frombuffer(b"".join(vocab[x]), t) for x, t in (("at", "<u4"), ("c", "<i8"), ("sizes", "<u4"), ("ids", "<u2")))
        # END is one more word, behind all others
        end = len(at)
        c, sizes, flat = np.append(c, n_end), np.append(sizes, 1).astype(np.int64), np.append(flat, END).astype("<u2")
        starts, row = np.append(0, np.cumsum(sizes)), np.full(end + 1, end)
        row[at] = np.arange(end)
        logs, known = np.log10(c + 1.0), (c > 0).astype(np.int64)
        n = pdf["seq"].str.len().to_numpy(np.int64) // 4 + 1
        parts = []
        for lo, hi in runs(n, RUN_WORDS):
            own = n[lo:hi]
            begins = np.cumsum(own) - own
            words_ = np.ones(own.sum(), bool)
            words_[begins + own - 1] = False
            which = np.full(len(words_), end)
            which[words_] = row[np.frombuffer(b"".join(pdf["seq"].iloc[lo:hi]), "<u4")]
            cuts = 2 * np.append(0, np.cumsum(np.add.reduceat(sizes[which], begins)))
            ids = gathered(flat, starts, which).tobytes()
            parts.append(pd.DataFrame({"n_tokens": own, "n_known": np.add.reduceat(known[which], begins), "base_score": np.add.reduceat(logs[which], begins) - own * floor_, "ids": [ids[i:j] for i, j in zip(cuts, cuts[1:])]}))
        out = pd.concat(parts).assign(train_tokens=n_train)
        return out.assign(doc_id=pdf["doc_id"].values, train=pdf["train"].values)[[x.split()[0] for x in CODED.split(", ")]]

    own = vocab.filter("block is not null").select("block", "at", "c", "sizes", "ids")
    sequences = cut(rows.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(run, CODED), "sequences", "zstd")
    drop(dealt), drop(vocab)
    return sequences, Coding(ids)


def score_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> SCORES, a row for each row."""
    rows, code = coded(docs)
    model, _ = train(rows.filter("train"), code)
    shared = docs.sparkSession.sparkContext.broadcast((model, code))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_freed_memory()
        model, code = shared.value
        for own, ids, sizes in chunks(batches):
            yield own.assign(held_out=~own["train"], score=sequence_scores(model, code, ids, sizes))[[x.split()[0] for x in SCORES.split(", ")]]

    return rows.mapInPandas(run, SCORES)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
