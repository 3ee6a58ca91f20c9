"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the urls no rule fits.

The rules decide their urls; those decisions are also the labels the trees learn from. Features are lexical: lengths,
depth, digit and letter ratios, entropy, counts of parameters and marks, and the smoothed share of blocked urls for
the last one and two labels of the host and for its first label and the first path segment, counted by Spark over all
labelled urls. Shares are a table that every url's four keys are joined to; values of many urls (at most HOT a kind)
are broadcast, the others are shuffled. The trees are fitted on at most FIT_ROWS labelled urls, in the order of a hash of
url and page_id (a documented bound); suffix statistics and verdicts cover all rows.

Defined cases: a null url, or one without ://, has empty host and path, no rule and the trees' verdict on empty
strings; without labelled urls of both kinds the trees allow everything; repeated rows get the same verdict (of ties in
the fit's order the url decides); urls are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import cut, table

#: (rule, verdict): host, then path from its slash on.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
FIT_ROWS, TREES, DEPTH, BINS, RATE = 20_000, 40, 3, 32, 0.2
#: A value that one url in HOT has, or more, is joined by broadcast.
HOT = 256
STATS = ("tld", "site", "sub", "segment")


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def stat_keys(host: Column, path: Column) -> dict[str, Column]:
    return {
        "tld": F.substring_index(host, ".", -1),
        "site": F.substring_index(host, ".", -2),
        "sub": F.substring_index(host, ".", 1),
        "segment": F.regexp_extract(path, "^/([^/]*)", 1),
    }


def lexical(url: str, host: str, path: str) -> list[float]:
    n = max(1, len(url))
    counts = np.array(list(Counter(url).values()), float)
    p = counts / max(1.0, counts.sum())
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count("."), digits, digits / n,
        sum(c.isdigit() for c in host), host.count("-"), sum(c.isalpha() for c in url) / n, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        len([x for x in query.split("&") if x]), url.count("="), url.count("%"), "#" in url, url.startswith("https"),
        host.startswith("www."), path.endswith("/"), path.rpartition("/")[2].count("."), max(map(len, host.split("."))),
    ]


class Trees:
    """Boosted regression trees for log-loss on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self.binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees, score = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(bins, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += RATE * self.leaf(tree, bins)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    def grow(self, bins, grad, hess, at, depth):
        g, h = grad[at].sum(), hess[at].sum() + 1.0
        best = (1e-6, None, None)
        if depth and len(at) >= 20:
            for f in range(bins.shape[1]):
                gs, hs = (np.cumsum(np.bincount(bins[at, f], v[at], BINS))[:-1] for v in (grad, hess))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs) - g * g / h
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        if f is None:
            return g / h
        low = bins[at, f] <= k
        return f, k, self.grow(bins, grad, hess, at[low], depth - 1), self.grow(bins, grad, hess, at[~low], depth - 1)

    def leaf(self, tree, bins: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        f, k, low, high = tree
        return np.where(bins[:, f] <= k, self.leaf(low, bins), self.leaf(high, bins))

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return 1 / (1 + np.exp(-(self.base + RATE * sum(self.leaf(t, bins) for t in self.trees))))


SHARES = tuple(f"{k}_share" for k in STATS)


def design(pdf: pd.DataFrame) -> np.ndarray:
    """Lexical features, then the block share of each suffix."""
    lex = [lexical(u or "", h, p) for u, h, p in zip(pdf["url"], pdf["host"], pdf["path"])]
    return np.hstack([np.array(lex, float).reshape(len(pdf), -1), pdf[list(SHARES)].to_numpy(float)])


def key_shares(parts: DataFrame, base: float, total: int) -> DataFrame:
    """parts(STATS, block) -> (kind, value, share, hot): the smoothed share of blocked urls of each value; base where none is labelled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in STATS))).alias("pair")
    counted = parts.select("block", pairs).groupBy("pair.kind", "pair.value").agg(F.count(F.lit(1)).alias("urls"), F.count("block").alias("n"), F.coalesce(F.sum("block"), F.lit(0)).alias("blocked"))
    share = (F.col("blocked") + 5 * base) / (F.col("n") + 5)
    return cut(counted.select("kind", "value", share.alias("share"), (F.col("urls") * HOT >= total).alias("hot")), "url_shares")


def with_shares(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """parts with SHARES, a column a kind. Rows of hot values are spread over the cold join, where they match nothing."""
    for k, name in zip(STATS, SHARES):
        own = shares.filter(F.col("kind") == k)
        hot = own.filter("hot").select(F.col("value").alias(k), F.col("share").alias("hot_share"))
        # no literal, which the optimizer would take out of the join's keys
        zero = F.when(F.col("share") < 0, 1).otherwise(0)
        cold = own.filter("not hot").select(F.col("value").alias(k), zero.alias("salt"), F.col("share").alias("cold_share"))
        salt = F.when(F.col("hot_share").isNotNull(), 1 + F.pmod(F.xxhash64("url", "page_id"), F.lit(1024)).cast("int")).otherwise(0)
        parts = parts.join(F.broadcast(hot), k, "left").withColumn("salt", salt).join(cold, [k, "salt"], "left")
        parts = parts.withColumn(name, F.coalesce("hot_share", "cold_share")).drop("hot_share", "cold_share", "salt")
    return parts


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path, rule, verdict, p_block)."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    parts = parts.withColumn("by_rule", F.try_element_at(verdicts, F.col("rule"))).withColumns(stat_keys(F.col("host"), F.col("path")))
    parts = parts.withColumn("block", (F.col("by_rule") == "block").cast("int"))

    totals = parts.agg(F.count(F.lit(1)).alias("urls"), F.count("block").alias("n"), F.coalesce(F.sum("block"), F.lit(0)).alias("blocked")).first()
    base = totals["blocked"] / max(1, totals["n"])
    if 0 < totals["blocked"] < totals["n"]:
        shares = key_shares(parts, base, totals["urls"])
        fit = with_shares(parts.filter("block is not null").orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(FIT_ROWS), shares).orderBy(F.xxhash64("url", "page_id"), "url", "page_id").toPandas()
        model = Trees(design(fit), fit["block"].to_numpy(float))

        def judge(url: pd.Series, host: pd.Series, path: pd.Series, tld: pd.Series, site: pd.Series, sub: pd.Series, segment: pd.Series) -> pd.Series:
            if not len(url):
                return pd.Series(np.zeros(0))
            return pd.Series(model.probability(design(pd.DataFrame(dict(zip(("url", "host", "path", *SHARES), (url, host, path, tld, site, sub, segment)))))))

        out = with_shares(parts, shares).withColumn("p_block", F.pandas_udf(judge, "double")("url", "host", "path", *SHARES))
    else:
        out = parts.withColumn("p_block", F.lit(0.0))
    by_trees = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), F.round("p_block", 6).alias("p_block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1_url_filter() what the rules alone decide."""
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


_FITS = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in RULES)
URL_RULES_SQL = rf"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
u AS (SELECT page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM p),
rules(rule, name, start, verdict) AS (VALUES {_FITS}),
fits AS (SELECT u.page_id, rule, verdict FROM u JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) QUALIFY row_number() OVER (PARTITION BY u.page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN fits USING (page_id)
"""
