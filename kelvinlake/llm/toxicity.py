"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model is fitted on at most fit_rows labelled documents, taken in the order of a hash of doc_id (a documented bound,
which also makes their labels small enough to broadcast, so that no text is shuffled). Features are words and word
beginnings (4 to 6 letters), present or not. Spark counts how many toxic and clean ones of them hold each feature; all that
are over-represented in toxic ones (log-odds over 1, MIN_Z standard errors, MIN_DOCS documents) make up the model's
vocabulary, which the bound on fitted rows bounds too. The table's label is binary, so severity grades come from the dose: clean rows are grade 0, toxic rows
1, 2 or 3 by how many distinct words of theirs hold a term with log-odds of at least 2 (up to 2, 3 to 4, more). One weight vector is
shared by the ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k). Every document is graded; the output is
the expected grade and P(grade > 0); a document is toxic from P >= 0.5.

Defined cases: a null or empty text has no features; without labels, or with labels of one class only, no document
is toxic and expected severity is 0; null labels or ids are left out of the fit; repeated rows get the same grade;
repeated labels of one doc_id count as toxic if any is; texts are read whole; an empty table gives no rows; a column of
the result's name is replaced, other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, ship, table

FIT_ROWS, MIN_DOCS, MIN_Z = 20_000, 4, 2.8
LETTERS = regex.compile(r"\p{L}+")


def features(text: str | None) -> dict[str, list[str]]:
    """The features of each distinct word: itself and its beginnings."""
    return {w: [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)] for w in set(LETTERS.findall((text or "").lower()))}


def count_terms(labelled: DataFrame) -> DataFrame:
    """labelled(toxic, text) -> (term, n_toxic, n_clean), over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = (Counter(), Counter())
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                both[toxic].update({t for ts in features(text).values() for t in ts})
            terms = list({*both[0], *both[1]})
            yield pd.DataFrame({"term": terms, "n_toxic": [both[1][t] for t in terms], "n_clean": [both[0][t] for t in terms]})

    parts = labelled.select("toxic", "text").mapInPandas(run, "term string, n_toxic long, n_clean long")
    return parts.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


class Model:
    """terms: place of each term; strong: log-odds >= 2; weights, thresholds: as fitted."""

    def __init__(self, terms: dict[str, int], strong: set[str]):
        self.terms, self.strong = terms, strong
        self.weights, self.thresholds = np.zeros(len(terms)), np.zeros(0)

    def row(self, text: str | None) -> tuple[list[int], int]:
        """Places of the terms present; the dose: how many distinct words hold a strong term."""
        found = features(text).values()
        held = {self.terms[t] for ts in found for t in ts if t in self.terms}
        return sorted(held), sum(any(t in self.strong for t in ts) for ts in found)

    def above(self, rows: list[list[int]]) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        z = np.array([self.weights[r].sum() for r in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_terms: int, rounds: int = 800, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds: Adam on the mean log-loss of grade > k over the thresholds."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.fromiter((t for r in rows for t in r), np.int64, len(at))
    levels = np.arange(grades.max())
    target = (grades[:, None] > levels).astype(float)
    share = np.clip(target.mean(0), 1e-4, 1 - 1e-4)
    x = np.concatenate([np.zeros(n_terms), np.log((1 - share) / share)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        z = np.bincount(at, x[term], len(rows))
        p = 1 / (1 + np.exp(np.clip(x[None, n_terms:] - z[:, None], -50, 50)))
        err = (p - target) / len(rows)
        g = np.concatenate([np.bincount(term, err.sum(1)[at], n_terms) + decay * x[:n_terms], -err.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        x[n_terms:] = np.maximum.accumulate(x[n_terms:])
    return x[:n_terms], x[n_terms:]


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(cut(picked, "picked")), "doc_id")
    # of a doc_id that repeats one text counts, so at most fit_rows rows are fetched below
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("code"), "text")).alias("first"))
    labelled = cut(one.select("toxic", "first.text"), "labelled")
    n_of = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    model = Model({}, set())
    if len(n_of) < 2:
        return model
    odds = F.log(((F.col("n_toxic") + 0.5) / (n_of[1] + 1)) / ((F.col("n_clean") + 0.5) / (n_of[0] + 1)))
    z = F.col("odds") / F.sqrt(1 / (F.col("n_toxic") + 0.5) + 1 / (F.col("n_clean") + 0.5))
    terms = count_terms(labelled).withColumn("odds", odds).filter((F.col("n_toxic") >= MIN_DOCS) & (F.col("odds") > 1) & (z >= MIN_Z))
    top = terms.select("term", "odds").orderBy("term").collect()  # words of at most fit_rows documents, MIN_DOCS of them each
    if not top:
        return model
    model = Model({r["term"]: i for i, r in enumerate(top)}, {r["term"] for r in top if r["odds"] >= 2})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [model.row(t) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "terms": [r for r, _ in made], "dose": [d for _, d in made]})

    got = labelled.mapInPandas(run, "toxic int, terms array<int>, dose int").toPandas()
    grade = got["toxic"].to_numpy() * (1 + (got["dose"].to_numpy() >= 3) + (got["dose"].to_numpy() >= 5))
    if grade.max(initial=0) > 0:
        model.weights, model.thresholds = fit_ordinal([list(r) for r in got["terms"]], grade.astype(int), len(top))
    return model


def grade_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `p_toxic` (P(grade > 0)) and `severity` (the expected grade)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as its terms are

    def grades(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not len(m.thresholds):
            return pd.DataFrame({"p_toxic": np.zeros(len(texts)), "severity": np.zeros(len(texts))})
        p = m.above([m.row(t)[0] for t in texts])
        return pd.DataFrame({"p_toxic": p[:, 0], "severity": p.sum(1)})

    return docs.withColumn("toxicity", F.pandas_udf(grades, "p_toxic double, severity double")("text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = grade_toxicity(docs, model)
    p, s = F.col("toxicity.p_toxic"), F.col("toxicity.severity")
    return out.select("doc_id", F.round(p, 6).alias("p_toxic"), F.round(s, 6).alias("severity"), F.floor(s + 0.5).cast("int").alias("grade"), (p >= 0.5).alias("toxic"))
