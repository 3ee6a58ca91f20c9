r"""Line dedup with DataFrame functions only.

A line's key is the line with blanks [\x20\x09-\x0D] stripped at both ends and A-Z lower-cased. Keys of at least
min_chars code points found in at least min_docs documents lose all their lines except in the largest doc_id
that holds them. Rows (key hash, document, position) are dealt out by range over (hash, document), so that a line
which a third of all documents hold spreads over many tasks; a secondary sort by position streams the first
occurrence in each document, and counts and maxima are pre-aggregated before they meet. Lines that hold a large share
of all rows (1,024 at most) are broadcast to theirs, the others are shuffled. The operator returns bitmaps, not text; a
bitmap is spread into an array before it meets its text, so a text of many lines is read in one pass.

Defined cases: a null or empty text is one empty line; rows with the same doc_id count as one document, and each
distinct text of it gets its own bitmap; a null doc_id is a document below all ids; an empty table gives no rows.
Keys meet as two 64-bit hashes with different seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvinlake.llm.common import BLANKS, NO_ID, UPPER, ascii_lower, cut, join_keys, partitions, table

MIN_CHARS, MIN_DOCS = 20, 3


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ident(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"], F.lit(NO_ID)), F.xxhash64(docs["text"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_key, text_key, n_dropped, keep): a row for each text that loses lines.

    keep holds (word, bits) for those words of 64 lines only that lose one; a set bit keeps its line, and lines of
    absent words stay.
    """
    doc, text = _ident(docs)
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    rows = docs.select(doc.alias("doc_key"), text.alias("text_key"), F.posexplode(text_lines(docs["text"])).alias("pos", "line"))
    rows = rows.filter(F.length("line") >= min_chars).withColumn("key", key).filter(F.length("key") >= min_chars)
    rows = rows.select("doc_key", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    rows = cut(rows, "lines")

    dealt = rows.select("h1", "h2", "doc_key", "pos").repartitionByRange(partitions(docs.sparkSession), "h1", "h2", "doc_key")
    in_doc = Window.partitionBy("h1", "h2", "doc_key")
    firsts = dealt.withColumns({"nth": F.row_number().over(in_doc.orderBy("pos")), "times": F.count(F.lit(1)).over(in_doc)}).filter("nth = 1")
    per_line = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("times").alias("n_rows"), F.max("doc_key").alias("keeper"))
    shared = cut(per_line.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "n_rows", "keeper"), "shared")

    lost = join_keys(rows, shared, ["h1", "h2"], "n_rows", rows.count()).filter(F.col("doc_key") != F.col("keeper"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    by_word = lost.groupBy("doc_key", "text_key", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return by_word.groupBy("doc_key", "text_key").agg(
        F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def spread(keep: Column) -> Column:
    """The words of a bitmap by their number, all bits set where the bitmap holds none."""
    since = lambda i: F.when(i == 0, -1).otherwise(F.element_at(keep, F.greatest(i, F.lit(1)))["word"])
    return F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - since(i) - 1), F.array(x["bits"]))))


def kept_lines(text: Column, words: Column) -> Column:
    """The lines of text whose bits are set in the spread() bitmap."""
    return F.filter(text_lines(text), lambda _, i: F.coalesce(F.getbit(F.get(words, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs as struct `row`, with the text after dedup as `kept_text` and the count `n_dropped`."""
    doc, text = _ident(docs)
    maps = keep_bitmaps(docs, min_chars, min_docs).select("doc_key", "text_key", "n_dropped", spread(F.col("keep")).alias("words")).hint("shuffle_hash")
    full = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc_key"), text.alias("text_key"))
    joined = full.join(maps, ["doc_key", "text_key"], "left")
    body = F.col("row.text")
    new = F.when(F.col("words").isNull(), body).otherwise(F.array_join(kept_lines(body, F.col("words")), "\n"))
    return joined.select("row", new.alias("kept_text"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        F.size(text_lines(F.col("row.text"))).cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP3_SQL = rf"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k) GROUP BY doc_id
"""
