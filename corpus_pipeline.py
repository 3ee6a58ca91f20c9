"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and
reads it back as the next stage's docs. All but the last return the columns they were given, with n_chars kept in step
with the text. Rows with null columns pass through; a null text stays null until packing, where it is its end id.
Other columns, whatever their names, pass through all but the last stage: stages work beside a struct of the row. An
empty table, or one of empty texts, passes all stages; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, ship, table
from kelvinlake.llm.line_dedup import dedup_lines
from kelvinlake.llm.near_dedup import LAST_ID, clustered
from kelvinlake.llm.packing import pack_documents
from kelvinlake.llm.secret_scan import masked
from kelvinlake.llm.toxicity import fit_toxicity, grade_toxicity

TOXIC_AT = 0.5


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """The struct column `row` as columns again, with another text and its length."""
    changed = {"text": text, "n_chars": F.when(text.isNull(), F.col("row.n_chars") if "n_chars" in columns else F.lit(None)).otherwise(F.length(text).cast("long"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose chance to be of grade 1 or more reaches TOXIC_AT."""
    model = fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = grade_toxicity(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return rows.filter(F.col("toxicity.p_toxic") < TOXIC_AT).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in 3 documents or more stay in the largest doc_id only."""
    return _with_text(dedup_lines(docs), docs.columns, F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least (doc_id, text) stays, a null doc_id standing last; of rows
    that repeat both, one. Rows without words are duplicates of nothing but such rows."""
    ship(spark)
    key = [F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.xxhash64("text").alias("_text")]
    found = clustered(docs)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    kept = found.filter(first).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.col("text_key").alias("_text")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)
    # repeats go before the join, within each task first, so a key that many rows share is no heavy one
    return rows.dropDuplicates(["_id", "_text"]).join(kept, ["_id", "_text"], "left_semi").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes [SECRET]."""
    ship(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), masked("text").alias("masked_text"))
    return _with_text(rows, docs.columns, F.col("masked_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Trained models decide in the first stage, and tokenizing ends the last: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
