"""Alignment of two tokenizers against whole-text alignment in plain Python."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kelvinlake.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, extra = {chr(x): x for x in plain}, 0
    for x in range(256):
        if x not in plain:
            letter[chr(256 + extra)] = x
            extra += 1
    name = {i: bytes(letter[ch] for ch in t) for t, i in vocab.items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, name, piece


def aligned(text, sides):
    a, b, name, piece = sides
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(name[i] for i in ids_a) != whole or b"".join(piece(i) for i in ids_b) != whole:
        return None
    ends = []
    for ids, of in ((ids_a, name.get), (ids_b, piece)):
        at, e = 0, []
        for i in ids:
            at += len(of(i))
            e.append(at)
        ends.append(e)
    both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return groups


def brute(docs, sides):
    found = [(d, aligned(t, sides)) for d, t in docs]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in found]
    count = Counter(p for c in links for p in c)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (d, g), c in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n  b\n\n c \n", "x▁y", "▁", "<|endoftext|> <s> </s>", "café 中文 \U0001f600 \U0001f600", "ﬁne ①", "  x  y", "aaaa" * 300, "0123456789" * 40, "\x00 \x01", "　 a　", "é ​ z", "don't won't 'S", "\r\n\t x"]


def test_odd_texts_and_words(spark, sides):
    rnd = random.Random(2)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "中", "▁", "'s", "7", "!", " ", " ", "\x1c", "\U0001f600", "<s>"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25)))) for i in range(600)]
    docs += [(None, "a b c"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, chunk int, pair string").repartition(3)
    got = Counter(tuple(r) for r in ta.align(df).select(*COLUMNS).collect())
    assert got == Counter(brute(docs, sides))


def test_no_rows_and_small_chunks(spark, sides, monkeypatch):
    assert ta.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ta.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("n_links", "groups_sha256").distinct().collect() == [(0, "")]


def test_salted_stripes_give_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    want = sorted(map(tuple, ta.align(docs).collect()))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ta.STRIPES * 2))
    try:
        got = sorted(map(tuple, ta.align(docs.repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert got == want


def test_translations(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the cat sat")], "doc_id long, text string")
    rows = ta.translations(ta.pair_counts(ta.document_links(docs))).collect()
    a = ta.words(ta.SIDE_A, ta.SIDE_B).aligner
    named = {(a.bytes_a[r["a"]], a.bytes_b[r["b"]]): (r["documents"], r["best"]) for r in rows}
    assert named[b" the", b" the"] == (3, True) and named[b" cat", b" cat"][0] == 2


def test_query_against_whole_texts(spark, sides):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in ta.op12_token_alignment(spark, SF).collect())
    assert got == sorted(brute(docs, sides))
