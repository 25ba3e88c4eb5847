"""URL filters: host and path rules first, gradient-boosted trees on lexical features for every other url.

Rules name a host suffix and a path prefix; the longest rule that fits decides.  Urls that a rule decides are the
labelled ones: the trees learn the verdict from their lexical features (length, depth, digit ratio, entropy,
number of parameters, share of blocked urls under the last one and two labels of the host) and judge the rest.
Features, rules and trees are all built-in column expressions, so scoring stays inside the JVM; only at most
SAMPLE labelled feature rows, in the order of a hash of url and id, come to the driver for fitting the trees.  Block
rates are counted over all labelled urls for every suffix: the LITERAL commonest suffixes are a map in the plan, the
others are joined, so that a common suffix never is one task's join key.

Defined cases: a null url or one without ``://`` has empty host and path and is judged by the trees on zero
features; without labelled urls, or with one verdict only, every other url gets that verdict (allow if none);
repeated rows are judged each.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
LITERAL = 200
TREES, DEPTH, BINS, RATE = 20, 3, 32, 0.3
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "suffix1", "suffix2"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to one of ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.translate(F.substring_index(before, "/", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.substring(before, F.length(F.substring_index(before, "/", 1)) + 1, 1 << 30)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; rules: (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the lexical features; suffixes as text still."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length("u").cast("double")
    query = F.when(F.instr("u", "?") > 0, F.substring_index(F.expr("substring(u, instr(u, '?') + 1)"), "#", 1)).otherwise(F.lit(""))
    chars = F.expr("array_distinct(split(u, ''))")
    entropy = F.aggregate(chars, F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(_plogp((n - F.length(F.replace(F.col("u"), c, F.lit("")))) / n)))
    return df.withColumn("u", u).select(
        "*",
        n.alias("length"),
        (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        (F.length(F.regexp_replace("u", "[^0-9]", "")) / F.greatest(n, F.lit(1.0))).alias("digit_ratio"),
        F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        F.substring_index("host", ".", -1).alias("s1"),
        F.substring_index("host", ".", -2).alias("s2"),
    ).drop("u")


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log(2.0, F.when(p > 0, p).otherwise(1.0))).otherwise(0.0)


class Trees:
    """Boosted regression trees: nested (feature, threshold, left, right) or a leaf value."""

    def __init__(self, bias: float, trees: list, rates: list[dict[str, float]], prior: float, others: list[DataFrame | None] | None = None):
        self.bias, self.trees, self.rates, self.prior, self.others = bias, trees, rates, prior, others or [None] * len(rates)

    def with_suffix_rates(self, df: DataFrame) -> DataFrame:
        for k, (rates, others) in enumerate(zip(self.rates, self.others, strict=True), 1):
            known = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]) if rates else None
            rate = F.try_element_at(known, F.col(f"s{k}")) if rates else F.lit(None).cast("double")
            if others is None:
                df = df.withColumn(f"suffix{k}", F.coalesce(rate, F.lit(self.prior)))
                continue
            spread = F.concat(F.lit("\x01"), F.pmod(F.xxhash64("url"), F.lit(1 << 20)).cast("string"))  # no host has this
            df = df.withColumns({f"suffix{k}": rate, "other": F.when(rate.isNull(), F.col(f"s{k}")).otherwise(spread)})
            df = df.join(others, "other", "left").withColumn(f"suffix{k}", F.coalesce(f"suffix{k}", "rate", F.lit(self.prior))).drop("other", "rate")
        return df

    def margin(self) -> Column:
        def column(t):
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(FEATURES[t[0]]) <= t[1], column(t[2])).otherwise(column(t[3]))

        out = F.lit(self.bias)
        for t in self.trees:
            out = out + column(t)
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> tuple[float, list]:
    """Newton boosting of the logistic loss over quantile bins."""
    p = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.01
    bias = float(np.log(p / (1 - p)))
    z = np.full(len(y), bias)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    out = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)

        def grow(rows, left):
            value = float(rate * g[rows].sum() / (h[rows].sum() + 1))
            best = (1e-3, None, None)
            if left and len(rows) >= 20:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] is None:
                z[rows] += value
                return value
            f, k = best[1:]
            below = binned[rows, f] <= k
            return (f, float(cuts[f][k]), grow(rows[below], left - 1), grow(rows[~below], left - 1))

        out.append(grow(np.arange(len(y)), depth))
    return bias, out


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """Block rates over all rows with a verdict, and trees on at most ``sample`` of them."""
    row = F.col("page_id") if "page_id" in labelled.columns else F.lit(0)
    labelled = labelled.select("length", "depth", "digit_ratio", "entropy", "params", "s1", "s2", (F.col("verdict") == "block").cast("int").alias("y"), "url", row.alias("page_id")).withColumn("k", F.xxhash64("url", "page_id"))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = float((blocked + 0.5) / (n + 2)) if n else 0.0
    if blocked in (0, n):
        return Trees(-10.0 if not blocked else 10.0, [], [{}, {}], prior)
    rates, others = [], []
    for s in ("s1", "s2"):
        seen = labelled.groupBy(F.col(s).alias("other")).agg(((F.sum("y") + prior) / (F.count("*") + 1)).alias("rate"), F.count("*").alias("n"))
        most = seen.orderBy(F.desc("n"), "other").limit(LITERAL + 1).collect()
        rates.append({r["other"]: r["rate"] for r in most[:LITERAL]})
        others.append(seen.where(~F.col("other").isin(list(rates[-1]))).select("other", "rate") if len(most) > LITERAL else None)
    model = Trees(0.0, [], rates, prior, others)
    # A share of the rows by their hash, so that no task sends many more than are wanted.
    few = labelled.where(F.pmod("k", F.lit(1 << 30)) < min(1 << 30, -(-(sample + 10 * math.isqrt(sample)) * (1 << 30) // n)))
    rows = model.with_suffix_rates(few.orderBy("k", "url", "page_id").limit(sample)).select("k", "url", "page_id", "y", *FEATURES).collect()
    rows.sort(key=lambda r: (r["k"], r["url"], r["page_id"] is not None, r["page_id"] or 0))
    x, y = np.array([[r[f] for f in FEATURES] for r in rows], float), np.array([r["y"] for r in rows], float)
    model.bias, model.trees = fit_trees(x, y)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block) for each row of pages."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = lexical(df.withColumns({"rule": rule, "verdict": verdict}))
    model = fit(df.where(F.col("verdict").isNotNull()))
    df = model.with_suffix_rates(df).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
