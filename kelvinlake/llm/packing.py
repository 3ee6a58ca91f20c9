"""Hierarchical multi-length packing of documents into training windows.

Every document's ids (with an end id) are cut into whole 2048-token windows; what remains is routed to the
context-size tier that just holds it. Pieces wait in a pool of up to POOL; a full pool is packed tier by tier, from the
longest to the shortest: each window opens with the longest piece of its own tier, its gap is filled with whole pieces,
the best fitting (longest that goes in) first, found by an index of lengths, and only where none goes in with the head of
a cut piece, whose tail is routed again. So every window is full, at a power-of-two size that needs no
padding, but for one a task. Windows of one tier are dealt to step groups in serpentine order of their number of
pieces, so the steps of a tier hold alike many documents.

Packing needs no shuffle: each partition streams through its own rows and holds one batch of ids and the pool, POOL pieces
of less than the longest tier. Sequence ids carry the partition's number. Defined cases: a null or empty text is its end
id alone; a text of any length is packed whole; repeated rows, ties in length and null doc_ids are packed like any others
(of pieces of one length the first to come goes first); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from kelvinlake.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 1
TIERS = (2048, 1024, 512, 256)
GROUP = 32
POOL = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


class Packer:
    """Packs pieces (document, its ids from start on, start, document's tokens); windows come out as lists of pieces."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.of_size: list[deque] = [deque() for _ in range(tiers[0] + 1)]
        #: Bit n is set where a piece of n ids waits.
        self.sizes, self.waiting = 0, 0

    def put(self, piece: tuple) -> None:
        self.of_size[len(piece[1])].append(piece)
        self.sizes |= 1 << len(piece[1])
        self.waiting += 1

    def take(self, size: int) -> tuple:
        piece = self.of_size[size].popleft()
        if not self.of_size[size]:
            self.sizes ^= 1 << size
        self.waiting -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        """Whole windows of the document at once; the rest waits."""
        longest, n = self.tiers[0], len(ids)
        whole = n - n % longest
        for at in range(0, whole, longest):
            yield longest, [(doc, ids[at : at + longest], at, n)]
        if whole < n:
            self.put((doc, ids[whole:].copy(), whole, n))

    def longest(self, limit: int) -> int:
        """The length of the longest piece of at most limit ids; 0 if there is none."""
        return max(0, (self.sizes & ((2 << limit) - 1)).bit_length() - 1)

    def filler(self, gap: int) -> tuple | None:
        """The longest piece that fits into the gap, or else the head of the shortest that waits."""
        if size := self.longest(gap):
            return self.take(size)
        if not self.sizes:
            return None
        doc, ids, at, n = self.take((self.sizes & -self.sizes).bit_length() - 1)
        self.put((doc, ids[gap:], at + gap, n))
        return doc, ids[:gap], at, n

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple]]]:
        """Windows of all tiers from the pool; the pieces of one that stays open wait for more, unless this is the last call."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while (size := self.longest(tier)) > below:
                pieces, gap = [self.take(size)], tier - size
                while gap and (piece := self.filler(gap)):
                    pieces.append(piece)
                    gap -= len(piece[1])
                if gap and not last:  # nothing is left but these
                    for piece in pieces:
                        self.put(piece)
                    return
                yield tier, pieces


def step_groups(sizes: list[tuple[int, int]]) -> list[int]:
    """(tier, pieces) of each window -> its group within its tier: groups of about GROUP windows, dealt in serpentine order."""
    out = [0] * len(sizes)
    for tier in {t for t, _ in sizes}:
        own = sorted((i for i, (t, _) in enumerate(sizes) if t == tier), key=lambda i: (-sizes[i][1], i))
        k = max(1, len(own) // GROUP)
        for rank, i in enumerate(own):
            lap, at = divmod(rank, k)
            out[i] = at if lap % 2 == 0 else k - 1 - at
    return out


def pack_documents(docs: DataFrame, path: str = VOCABULARY, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece (SCHEMA); pieces of a sequence lie gapless from offset 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, packer = encoder(path), Packer(tiers)
        base, n_windows, n_groups = TaskContext.get().partitionId() << 36, 0, 0

        def shown(windows: list) -> pd.DataFrame:
            nonlocal n_windows, n_groups
            rows = []
            groups = step_groups([(t, len(ps)) for t, ps in windows])
            first = {}  # the number of each tier's first group
            for tier in sorted({t for t, _ in windows}):
                first[tier] = n_groups
                n_groups += 1 + max(g for g, (t, _) in zip(groups, windows) if t == tier)
            for (tier, pieces), group in zip(windows, groups):
                offset = 0
                for doc, ids, at, n in pieces:
                    rows.append((doc, at, len(ids), zlib.crc32(ids), n, base + n_windows, offset, tier, base + first[tier] + group))
                    offset += len(ids)
                n_windows += 1
            return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

        for pdf in batches:
            ids_of = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
            out = []
            for doc, text in zip(ids_of, pdf["text"].fillna("")):
                ids = np.array(enc.encode(text, allowed_special="all") + [END_ID], dtype="<u4")
                out += packer.add(None if doc is None else int(doc), ids)
                if packer.waiting >= POOL:
                    out += packer.windows(last=False)
            if out:
                yield shown(out)
        if out := list(packer.windows(last=True)):
            yield shown(out)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
