"""Byte-level BPE encoding and decoding with a pair occurrence index.

Within a batch of a partition the distinct pre-tokens lie one behind another in flat arrays. An index maps the rank
of each mergeable pair to all positions where it occurs; ranks are applied in ascending order, each to all of its
positions at once, and the neighbours' new pairs enter the index. A merge only makes pairs of higher rank (checked
when the vocabulary is loaded), so one pass over the ranks is enough. The vocabulary file's path is a parameter;
every worker reads it once.

Defined cases: a null or empty text has no ids and decodes to the empty text; the special token's string in a text
becomes its one id; ids are decoded as bytes, ill-formed UTF-8 by the replacement character; repeated rows are encoded
like any others and null doc_ids kept as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from kelvinlake.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pre-tokens whose ids a worker keeps from one batch to the next.
KEEP_WORDS = 400_000
#: Longer ones are not kept.
KEEP_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[ch] for ch in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for i, raw in enumerate(self.bytes[: len(vocab)]):
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges])
        self.right = np.array([vocab[b] for _, b in merges])
        self.made = np.array([vocab[a + b] for a, b in merges])
        made_at = np.full(size, -1)
        made_at[self.made] = np.arange(len(merges))
        if (np.maximum(made_at[self.left], made_at[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        code = self.left << 32 | self.right
        self.order = np.argsort(code)
        self.codes = code[self.order]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is none."""
        code = left << 32 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.order[at], -1)

    def encode_distinct(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece; a special token's string is a piece of its own and has its one id."""
        if not pieces:
            return []
        out = self._merged(pieces)
        for i, p in enumerate(pieces):
            if p in self.special:
                out[i] = (self.special[p],)
        return out

    def _merged(self, pieces: list[str]) -> list[tuple[int, ...]]:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(ids)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1

        index: list[list[np.ndarray]] = [[] for _ in self.made]

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(ids[at], ids[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at):
                by = np.argsort(rank, kind="stable")
                at, rank = at[by], rank[by]
                first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
                for r, lo, hi in zip(rank[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                    index[r].append(at[lo:hi])

        enter(np.flatnonzero(after >= 0))
        for rank in range(len(index)):
            if not index[rank]:
                continue
            a, b = self.left[rank], self.right[rank]
            at = np.unique(np.concatenate(index[rank]))
            index[rank] = []
            at = at[ids[at] == a]
            right = after[at]
            ok = right >= 0
            ok[ok] = ids[right[ok]] == b
            at, right = at[ok], right[ok]
            if a == b and len(at) > 1:  # of overlapping pairs in a run, the first, third, ... are merged
                start = np.r_[True, right[:-1] != at[1:]]
                run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                odd = (np.arange(len(at)) - run) % 2 == 0
                at, right = at[odd], right[odd]
            if not len(at):
                continue
            beyond = after[right]
            ids[at], ids[right] = self.made[rank], -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            prior = before[at]
            enter(np.unique(np.concatenate([prior[prior >= 0], at[beyond >= 0]])))
        live = ids >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        flat = ids[live].tolist()
        return [tuple(flat[lo:hi]) for lo, hi in zip(counts[ends - lengths].tolist(), counts[ends].tolist())]

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.pattern.findall(part))]

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of each of its pieces."""
        cut = [self.pieces(x) for x in texts]
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        known = self.known
        fresh = list(set().union(*cut).difference(known)) if cut else []
        if fresh:
            known.update(zip(fresh, self.encode_distinct(fresh)))
        out = [[known[w] for w in ws] for ws in cut]
        for w in fresh:
            if len(w) > KEEP_CHARS:
                del known[w]
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


@functools.cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in batches:
            coded = bpe.encode_batch(pdf["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [[i for w in ws for i in w] for ws in coded]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [bpe.decode(x) for x in pdf["ids"]]})

    return coded.mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Ids are listed and decoded once for each distinct piece, and the pieces are joined.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        listed: dict[str, str] = {}
        back: dict[str, bytes] = {}
        for pdf in batches:
            cut = [bpe.pieces(x) for x in pdf["text"].fillna("")]
            if len(listed) > KEEP_WORDS:
                listed.clear(), back.clear()
            fresh = list(set().union(*cut).difference(listed))
            for w, ids in zip(fresh, bpe.encode_distinct(fresh)):
                listed[w] = ",".join(map(str, ids))
                back[w] = b"".join([bpe.bytes[i] for i in ids])
            rows = []
            for ws in cut:
                shown = ",".join([listed[w] for w in ws])
                text = b"".join([back[w] for w in ws]).decode("utf-8", "replace")
                rows.append((shown.count(",") + bool(ws), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            for w in fresh:
                if len(w) > KEEP_CHARS:
                    del listed[w], back[w]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.assign(doc_id=pdf["doc_id"].values)[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
