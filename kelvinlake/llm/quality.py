r"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document's statistics. Expectation-maximisation over the counts of the
distinct vote patterns estimates the share of good documents and each rule's accuracies, without labels; a
document's verdict is its pattern's posterior probability of being good. Patterns are counted by Spark over all
documents; there are at most 3^rules of them, which bounds what reaches the driver and is sent back.

Words are [^\x20\x09-\x0D]+, as written. Defined cases: a null or empty text has no words and fails the base rule;
texts are read whole; rows are judged each by itself, so repeated rows get the same verdict, as do rows whose votes tie;
a null doc_id is kept as it is; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, table

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_caps long, n_plain long, n_marked long, n_distinct long"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
KEEP_AT = 0.5
#: What each rule is taken to do before the data speak: right in so many of its votes.
PRIOR_ACCURACY, PRIOR_WEIGHT = 0.8, 20.0
#: A word of letters with at most one mark behind it; a word that ends with two marks or more.
PLAIN = regex.compile(r"[\"'(]?[\p{L}\p{M}'’-]+[.,;:?!)\"']?")
MARKED = regex.compile(r".*[^\p{L}\p{M}\p{N}]{2,}", regex.S)


@functools.lru_cache(200_000)
def plain(word: str) -> bool:
    return bool(PLAIN.fullmatch(word))


@functools.lru_cache(200_000)
def marked(word: str) -> bool:
    return bool(MARKED.fullmatch(word))


def repeat_words(ids: np.ndarray) -> int:
    """How many words lie in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    times = Counter(words)
    number = {w: i for i, w in enumerate(times)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    of = lambda holds: sum(n for w, n in times.items() if holds(w))
    lines = Counter(x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").strip())
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        sum(n - 1 for n in lines.values()),
        repeat_words(ids),
        of(lambda w: len(w) > 1 and w.isupper()),
        of(plain),
        of(marked),
        len(number),
    )


def quality_stats(text: str) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(x) for x in texts], columns=[x.split()[0] for x in STATS.split(", ")])

    return F.pandas_udf(run, STATS)(text)


def rule_votes() -> dict[str, Column]:
    """1 good, 0 bad, -1 abstains. Rates are per word; rules of one vote abstain elsewhere, the others leave a band open."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.col(c) / n
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    return {
        "length": vote(F.col("n_words") < 50, F.lit(False)),
        "symbols": vote(rate("n_symbols") > 0.1, rate("n_symbols") < 0.02),
        "repeats": vote(rate("n_repeat_words") > 0.3, F.lit(False)),
        "lines": vote(F.col("n_dup_lines") > 5, F.lit(False)),
        "capitals": vote(rate("n_caps") > 0.3, rate("n_caps") < 0.05),
        "plain": vote(rate("n_plain") < 0.7, rate("n_plain") > 0.9),
        "marked": vote(rate("n_marked") > 0.2, rate("n_marked") < 0.05),
        "variety": vote(rate("n_distinct") < 0.1, F.lit(False)),
    }


def fit_rules(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of good for each vote pattern: a two-class model whose rules vote independently given the class.

    votes: patterns x rules of 1, 0, -1; counts: documents of each pattern. Each rule has an accuracy for either
    class, with a prior that anchors the classes' meaning.
    """
    good = np.full(len(votes), 0.5)
    share, right = 0.7, np.full((2, votes.shape[1]), PRIOR_ACCURACY)
    for _ in range(rounds):
        odds = np.full(len(votes), np.log(share / (1 - share)))
        for j, v in enumerate(votes.T):
            odds += np.where(v == 1, np.log(right[1, j] / (1 - right[0, j])), np.where(v == 0, np.log((1 - right[1, j]) / right[0, j]), 0))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
        share = float(np.clip((counts @ good + 7) / (counts.sum() + 10), 0.01, 0.99))
        for j, v in enumerate(votes.T):
            for cls, weight in ((0, counts * (1 - good)), (1, counts * good)):
                hit, cast = weight[v == cls].sum(), weight[v >= 0].sum()
                right[cls, j] = np.clip((hit + PRIOR_WEIGHT * PRIOR_ACCURACY) / (cast + PRIOR_WEIGHT), 0.5, 0.999)
    return good


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics, votes, p_good) for each row of docs(doc_id, text)."""
    rules = rule_votes()
    stats = docs.select("doc_id", quality_stats("text").alias("s")).select("doc_id", "s.*")
    stats = cut(stats.withColumn("votes", F.array(*rules.values())), "quality")
    seen = stats.groupBy("votes").count().orderBy("votes").collect()  # at most 3^rules rows
    votes = np.array([r["votes"] for r in seen]).reshape(len(seen), len(rules))
    good = fit_rules(votes, np.array([r["count"] for r in seen], float))
    model = docs.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, good)], "votes array<int>, p_good double")
    return stats.join(F.broadcast(model), "votes", "left")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= KEEP_AT)).alias("kept"), "p_good",
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7_quality() the counts of the base rule."""
    return op7_quality(spark, sf_dir).select("doc_id", *COUNTS)


QUALITY_COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM l GROUP BY ALL),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AND c IS NOT NULL AS again FROM t),
cover AS (SELECT doc_id, again OR lag(again, 1, false) OVER o OR lag(again, 2, false) OVER o AS held FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (held) AS n FROM cover GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
       length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
       len(w) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
"""
