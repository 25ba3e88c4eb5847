"""Features, blocking keys and candidate pairs.

All channels share one long key table (country, channel, key), so ten channels cost one join, not ten.  Bounds
on postings are explicit: a cap keeps the first n of a key in ``ord`` order, a suppression drops keys with more
than n.  ``ord`` is the entity id, which replaces file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import text as T
from ..plans.profiles import Profile

FEATURES = ["nn", "core", "sorted_core", "flat", "toks", "grams", "b_num", "post", "s_tok", "a_toks", "state", "metro", "brand", "first_tok", "indic", "name_toks", "addr_words"]
CHANNEL_ORDER = ["exact", "spaceless", "core", "sorted", "prefix", "number_token", "anchor", "token_street", "sound_street", "brand_state", "pin", "two_words", "number_tokens"]


def with_features(df: DataFrame, p: Profile, carry: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, src, country, the features of each record and the columns carry; records without a name or country
    go."""
    legal, stop = list(p.legal), list(p.stop)
    df = df.select("entity_id", F.substring_index("entity_id", "-", 1).alias("src"), F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("country"), F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("addr"), *carry)
    df = df.withColumns({"nn": T.normalize(F.col("name"), p.normalizer, p.accents), "na": F.coalesce(T.normalize(F.col("addr"), p.normalizer, p.accents), F.lit(""))})
    df = df.where("nn is not null and nn <> '' and country <> ''")
    nn, na, addr = F.col("nn"), F.col("na"), F.col("addr")
    df = df.withColumns({
        "core": T.core_name(nn, legal), "sorted_core": T.sorted_core(nn, legal, stop, p.distinct_core, p.least_core), "flat": T.spaceless(nn),
        "toks": F.array_distinct(T.without(T.words(nn), legal, stop)), "b_num": A.primary_number(addr), "post": A.postal_code(addr),
        "s_tok": F.when(A.primary_number(addr) > 0, A.street_token(na, stop)).otherwise("") if p.street_needs_number else A.street_token(na, stop), "a_toks": A.address_tokens(na, stop), "state": A.state(na, F.col("country"), p.wide_state), "metro": A.metro(na, F.col("country")),
        "indic": T.is_indic(F.col("name")), "grams": T.trigrams(nn),
    })
    return df.withColumns({"brand": T.first_long(F.col("toks"), 5), "first_tok": T.first_long(T.without(T.words(nn), legal, stop), 4), "name_toks": T.tokens(nn, 3, legal, stop), "addr_words": T.tokens(na, 3, legal, stop)}).drop("name", "addr", "na")


def keys(df: DataFrame, p: Profile) -> DataFrame:
    """One row a record and channel: (channel, key); a channel whose guards fail has no row."""
    c, sep = F.col, "\x01"
    cat = lambda *x: F.concat_ws(sep, *[F.col(y) if isinstance(y, str) else y for y in x])
    street = T.phonetic(c("s_tok")) if p.street_phonetic else c("s_tok")
    pre = F.when(F.length("nn") >= 4, F.substring("nn", 1, 4))
    num, st, brand = c("b_num") > 0, c("s_tok") != "", c("brand") != ""
    two = T.words(c("nn"))
    probe = c("entity_id").startswith("S1-") if p.loose_probe else F.lit(False)
    guard = (c("entity_id").startswith("S1-") | (c("core") != c("nn"))) if p.strict_probe else F.lit(True)
    made = {
        "exact": c("nn"),
        "spaceless": F.when(F.length("nn") >= 6, c("flat")),
        "core": F.when((c("core") != "") & (probe | (c("core") != c("nn"))), c("core")),
        "sorted": F.when((c("sorted_core") != "") & (probe | (c("sorted_core") != c("core"))) & guard, c("sorted_core")),
        "prefix": F.when(num & pre.isNotNull(), cat("b_num", pre)),
        "number_token": F.when(num & (c("first_tok") != ""), cat("b_num", "first_tok")),
        "anchor": F.when(num & st, cat("b_num", street)),
        "token_street": F.when(brand & st, cat("brand", "s_tok")),
        "sound_street": F.when(brand & st, cat("s_tok", "metro", T.phonetic(c("brand")))),
        "brand_state": F.when(brand & (c("state") != ""), cat("brand", "state")),
        "pin": F.when((c("post") != "") & pre.isNotNull(), cat("post", pre)),
        "two_words": F.when(F.size(two) >= 2, cat(F.get(two, F.lit(0)), F.get(two, F.lit(1)))),
    }
    every = F.array(*[F.struct(F.lit(k).alias("channel"), made[k].alias("key")) for k in p.channels if k in made])
    if "number_tokens" in p.channels:  # one key for each of the first two tokens
        pair = F.transform(F.slice("name_toks", 1, 2), lambda t: F.struct(F.lit("number_tokens").alias("channel"), F.when(num, cat("b_num", t)).alias("key")))
        every = F.array_distinct(F.concat(every, pair))
    return df.select("entity_id", "src", "country", F.explode(F.filter(every, lambda s: s["key"].isNotNull())).alias("k")).select("entity_id", "src", "country", "k.channel", "k.key")


def bounded(postings: DataFrame, p: Profile) -> DataFrame:
    """Postings after caps and suppression, with the size of their bucket."""
    by = ["country", "channel", "key"]

    def limit(table):
        out = F.when(F.lit(False), 0)
        for k, n in table.items():
            out = out.when(F.col("channel") == k, n)
        return out

    if p.caps:
        capped = F.col("channel").isin(list(p.caps))
        w = Window.partitionBy(*by).orderBy("entity_id")
        top = max(p.caps.values())
        kept = postings.where(capped).withColumn("n", F.row_number().over(w)).where(f"n <= {top}").where(F.col("n") <= limit(p.caps)).drop("n")
        postings = kept.unionByName(postings.where(~capped))
    size = postings.groupBy(*by).agg(F.count("*").alias("bucket"))
    if p.suppress:
        size = size.where(F.col("bucket") <= F.coalesce(limit(p.suppress), F.col("bucket")))
    return postings.join(size, by)


def candidates(features: DataFrame, p: Profile) -> DataFrame:
    """Pairs (s1, cid, src, channel, bucket) of a reference record and a target that share a key.  The pair's features
    are joined later, once a pair."""
    k = keys(features, p)
    ref, targets = k.where("src = 'S1'"), k.where("src <> 'S1'")
    by = ["country", "channel", "key"]
    if p.index_side == "targets":
        left, right = ref, bounded(targets, p)
    else:
        left, right = bounded(ref, p), targets
    return left.select(*by, F.col("entity_id").alias("s1"), *(["bucket"] if p.index_side != "targets" else [])).join(right.select(*by, F.col("entity_id").alias("cid"), "src", *(["bucket"] if p.index_side == "targets" else [])), by).select("s1", "cid", "src", "channel", "bucket")


def usable(features: DataFrame, p: Profile) -> DataFrame:
    """Postings (entity_id, src, country, channel, key) of both sides after the profile's caps and suppression: the
    candidates are the pairs that share a key."""
    k = keys(features, p)
    ref, targets = k.where("src = 'S1'"), k.where("src <> 'S1'")
    one, other = (targets, ref) if p.index_side == "targets" else (ref, targets)
    return bounded(one, p).select(*other.columns).unionByName(other)


def paired(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with the features of both sides, l_ for the reference and r_ for the target.  A pair with several
    channels meets its features once."""
    side = lambda x, key: features.select(F.col("entity_id").alias(key), *[F.col(f).alias(x + f) for f in FEATURES], *([F.col("country")] if x == "l_" else []))
    by = [c for c in pairs.columns if c not in ("channel", "bucket")]
    how = [c for c in pairs.columns if c in ("channel", "bucket")]
    if not how:
        return pairs.join(side("l_", "s1"), "s1").join(side("r_", "cid"), "cid")
    once = pairs.groupBy(*by).agg(F.collect_list(F.struct(*how)).alias("how"))
    return once.join(side("l_", "s1"), "s1").join(side("r_", "cid"), "cid").select("*", F.explode("how").alias("hit")).select("*", *[F.col(f"hit.{c}").alias(c) for c in how]).drop("how", "hit")
