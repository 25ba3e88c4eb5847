"""What blocking finds and misses: truth pairs, coverage and size of channels, lost pairs, grids and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from . import blocking, metrics, selection
from .scoring import L, R


def truth_pairs(features: DataFrame, truth: DataFrame) -> DataFrame:
    """The true pairs (s1, cid) of one country with the features of both records; pairs of unknown records go."""
    other = features.select(F.col("entity_id").alias("cid"), F.col("country").alias("r_country"))
    return blocking.paired(truth.select("s1", "cid"), features).join(other, "cid").where(F.col("r_country") == F.col("country")).drop("r_country")


def channel_tests() -> dict[str, Column]:
    """The ten tests of a pair, country apart."""
    num = S.same_number(L, R)
    shared_name, shared_addr = F.arrays_overlap(L.name_toks, R.name_toks), F.arrays_overlap(L.addr_words, R.addr_words)
    prefix = lambda x: F.substring(x, 1, 4)
    two = lambda x: F.slice(T.words(x), 1, 2)
    sound = lambda x: T.phonetic_reset(F.coalesce(F.get(T.words(x), F.lit(0)), F.lit("")))
    return {
        "exact": S.same(L.nn, R.nn),
        "core": S.same(L.core, R.core),
        "sorted": S.same(L.sorted_core, R.sorted_core),
        "anchor": num & S.same(L.s_tok, R.s_tok),
        "number_name": num & shared_name,
        "prefix": num & (F.length(L.nn) >= 4) & (prefix(L.nn) == prefix(R.nn)),
        "name_address": shared_name & shared_addr,
        "two_words": (F.size(two(L.nn)) == 2) & (two(L.nn) == two(R.nn)),
        "sound_number": num & S.same(sound(L.nn), sound(R.nn)),
        "number_address": num & shared_addr,
    }


def coverage(pairs: DataFrame) -> DataFrame:
    """channel, hits, pairs, recall over true pairs: each test, the three channels of v03, and the wider union."""
    tests = {k: F.coalesce(v, F.lit(False)) for k, v in channel_tests().items()}
    tests["v03"] = tests["exact"] | tests["core"] | tests["anchor"]
    tests["union"] = tests["v03"] | tests["sorted"] | tests["number_name"] | tests["number_address"] | tests["two_words"]
    x = pairs.select(*[v.cast("long").alias(k) for k, v in tests.items()]).agg(F.count("*").alias("pairs"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in tests])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(k).alias("hits")) for k in tests])).alias("r")
    return x.select("pairs", rows).select("r.channel", "r.hits", "pairs", F.when(F.col("pairs") > 0, F.col("r.hits") / F.col("pairs")).otherwise(0.0).alias("recall"))


def sizing(pairs: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    """channel, candidates, per_query, hits, recall, and of the union also median and p95 of candidates a query.
    pairs: (s1, cid, channel); reference: (s1) of every query."""
    pairs = pairs.select("s1", "cid", "channel").distinct()
    pairs = pairs.unionByName(pairs.select("s1", "cid", F.lit("union").alias("channel")).distinct())
    marked = pairs.join(truth.select("s1", "cid", F.lit(1).alias("true")), ["s1", "cid"], "left")
    queries, known = reference.agg(F.count("*").alias("queries")), truth.agg(F.count("*").alias("known"))
    x = marked.groupBy("channel").agg(F.count("*").alias("candidates"), F.count("true").alias("hits")).join(queries).join(known)
    each = reference.join(pairs.where("channel = 'union'").groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").fillna(0, ["n"])
    spread = metrics.size_profile(each, "n").select(F.lit("union").alias("channel"), "median", "p95")
    return x.join(spread, "channel", "left").select("channel", "candidates", (F.col("candidates") / F.col("queries")).alias("per_query"), "hits", F.when(F.col("known") > 0, F.col("hits") / F.col("known")).otherwise(0.0).alias("recall"), "median", "p95")


def lost_pairs(true: DataFrame, accepted: DataFrame, seen: DataFrame) -> DataFrame:
    """Each true pair: found, rejected (a candidate that no rule took) or the reason why it is no candidate."""
    l, r = L, R
    reason = metrics.miss_reason(T.is_non_latin(r.nn), F.arrays_overlap(l.name_toks, r.name_toks), S.number_missing(l, r), S.number_conflict(l, r))
    mark = lambda df, name: df.select("s1", "cid").distinct().withColumn(name, F.lit(True))
    x = true.join(mark(accepted, "ok"), ["s1", "cid"], "left").join(mark(seen, "was_seen"), ["s1", "cid"], "left")
    return x.select("s1", "cid", F.when(F.col("ok"), "found").when(F.col("was_seen"), "rejected").otherwise(reason).alias("outcome"))


def grid(pairs: DataFrame, truth: DataFrame, configs: dict[str, Column], choose) -> DataFrame:
    """entities, precision, recall, f_half of each configuration: a filter of scored pairs, then ``choose``.
    truth: (id, ids array) of every reference record.  All configurations go through one plan, whose s1 is a struct of
    configuration and id, so that pairs are made once and neither plan nor broadcasts grow with the configurations."""
    names = lambda *cols: truth.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in configs])).alias("config"), *cols)
    passed = F.explode(F.array_compact(F.array(*[F.when(keep, F.lit(name)) for name, keep in configs.items()])))
    tagged = pairs.withColumn("config", passed).withColumn("s1", F.struct("config", "s1")).drop("config")
    got = choose(tagged).groupBy(F.col("s1").alias("id")).agg(F.collect_set("cid").alias("ids"))
    every = truth.crossJoin(F.broadcast(names())).select(F.struct("config", F.col("id").alias("s1")).alias("id"), "ids")
    found = metrics.included_f(metrics.per_entity(got, every).withColumn("config", F.col("id.config")), ["config"])
    return names().join(found, "config", "left").select("config", F.coalesce("included", F.lit(0)).alias("included"), "precision", "recall", "f_half")


def strategies(pairs: DataFrame, truth: DataFrame, rules: dict[str, tuple[Column, int]]) -> DataFrame:
    """strategy, matches, entities, f_half: pairs that a rule lets pass, the first n a source in arrival order."""
    out = None
    for name, (passes, n) in rules.items():
        got = selection.first_n(pairs.where(passes).select("s1", "src", "cid").distinct(), n)
        counts = metrics.per_entity(got.groupBy(F.col("s1").alias("id")).agg(F.collect_set("cid").alias("ids")), truth)
        row = metrics.official_f(counts).join(got.agg(F.count("*").alias("matches"))).select(F.lit(name).alias("strategy"), "matches", "entities", "f_half")
        out = row if out is None else out.unionAll(row)
    return out


def key_counts(keys: DataFrame) -> DataFrame:
    """Distinct keys and postings by channel."""
    return keys.groupBy("channel").agg(F.countDistinct("country", "key").alias("keys"), F.count("*").alias("postings"))
