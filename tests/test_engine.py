"""Rules of the engine on literal cases, and invariants of the profiles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kindred import __main__ as cli
from kindred.functions import address as A
from kindred.functions import similarity as S
from kindred.functions import text as T
from kindred.operators import analysis, blocking, metrics, scoring, selection, validation
from kindred.plans import engine
from kindred.plans.profiles import PROFILES
from kindred.sources import fixtures, io
from kindred.streaming import matching

SF = "/root/testdata/sf0.001"


def one(spark, column, value, *more):
    names = ["x", *[f"y{i}" for i in range(len(more))]]
    return spark.createDataFrame([(value, *more)], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


def test_normalisers(spark):
    n = lambda v, mode, **k: one(spark, T.normalize(F.col("x"), mode, **k), v)
    assert n("Straße  ﬁne!", "exact") == "strasse fine" and n(" . ", "exact") is None and n(None, "latin") == ""
    assert n("Café Éclair", "latin") == "cafe eclair" and n("Café Éclair", "marks") == "cafe eclair"
    assert n("Café Éclair", "ascii") == "caf clair" and n("Café Éclair", "ascii", accents="fold") == "cafe eclair"
    assert n("Pvt.Inc acme.corp www.foo.com", "ascii") == "pvt c acme rp foo"
    assert n("a_b", "ascii") == "a_b" and n("a_b", "domains") == "a b"
    assert n("कमल", "champion") == "kml"
    assert one(spark, T.is_indic(F.col("x")), "कमल") and not one(spark, T.is_indic(F.col("x")), "abc")


def test_phonetic(spark):
    for pair, code in ((("aggarwal", "agarwal"), "a264"), (("chowdhury", "chaudhary"), "c360"), (("prasad", "prashad"), "p623"), (("centre", "center"), "c536")):
        assert {one(spark, T.phonetic(F.col("x")), w) for w in pair} == {code}
    assert one(spark, T.phonetic(F.col("x")), "pfister") == "p123" and one(spark, T.phonetic(F.col("x")), "tymczak") == "t520"


def test_phonetic_rule(spark):
    codes = {c: k for k, cs in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r")) for c in cs}
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))) for _ in range(500)]

    def rule(w):
        out, last = w[0], ""
        for c in w[1:]:
            if c in codes:
                out += codes[c] if codes[c] != last else ""
                last = codes[c]
        return (out + "0000")[:4]

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.phonetic(F.col("w")).alias("v")).collect()
    assert all(r["v"] == rule(r["w"]) for r in got)


def test_addresses(spark):
    number = lambda v: one(spark, A.primary_number(F.col("x")), v)
    assert [number(v) for v in ("12 Rd", "१२ रोड", "007 Ln", "99999999 X 5", "no", None, "0 X")] == [12, 12, 7, 0, 0, 0, 0]
    assert one(spark, A.postal_code(F.col("x")), "x 012345 y 302001 z") == "302001" and one(spark, A.postal_code(F.col("x")), "a 02115") == "02115"
    state = lambda a, c: one(spark, A.state(F.col("x"), F.col("y0")), a, c)
    assert state("x orissa y", "India") == "odisha" and state("tamilnadu", "india") == "tamil nadu" and state("goat farm", "india") == ""
    assert state("pune mh", "india") == "maharashtra" and state("in tx", "us") == "tx" and state("portland or", "us") == "or" and state("or road one two", "us") == ""
    assert one(spark, A.metro(F.col("x"), F.col("y0")), "old madras road", "India") == "chennai"


def test_trigrams_of_nothing(spark):
    assert one(spark, T.trigrams(F.col("x")), "") == [""] and one(spark, T.trigrams(F.col("x")), "ab") == ["ab"]


def _pair(spark, a, b, profile="v13"):
    rows = [("S1-1", *a, "India"), ("S2-1", *b, "India")]
    f = blocking.with_features(spark.createDataFrame(rows, io.RECORD), PROFILES[profile])
    return blocking.paired(spark.createDataFrame([("S1-1", "S2-1", "S2", "exact", 1)], "s1 string, cid string, src string, channel string, bucket int"), f)


def test_gate(spark):
    s1 = ("Om Constructions Pvt Ltd", "Karauli, Rajasthan, 322241")
    for name, addr, want in (("Om Construction LLP", "SECTOR-15 Faridabad Haryana", "state"), ("Om Consulting Private", "MEENANGADI POST, Kerala", "state"), ("Om Construction Company", "Pani Ki Tanki Ke Pas Choubepada, Karauli, Rajasthan", None)):
        assert _pair(spark, s1, (name, addr)).select(S.gate_reason(scoring.L, scoring.R, False, "words").alias("v")).first()["v"] == want
    near = _pair(spark, ("abc foods", "12 hill view"), ("abc foods", "15 hill view"))
    assert near.select(S.gate(scoring.L, scoring.R, False, "words").alias("v")).first()["v"] is False
    assert near.select(S.gate(scoring.L, scoring.R, True, "names").alias("v")).first()["v"] is True


def test_gate_without_proof(spark):
    """What passes without proof needs a side without address tokens; disjoint addresses never match."""
    name = ("om sai global exports", "arav lotus bela trade pvt ltd")
    for n in name:
        apart = _pair(spark, (n, "Lotus Gardens"), (n, "Temple Square"))
        bare = _pair(spark, (n, ""), (n, "Temple Square"))
        for relaxed, rule in ((False, "distinctive"), (True, "names"), (False, "words"), (True, "diagnostic")):
            reason = S.gate_reason(scoring.L, scoring.R, relaxed, rule).alias("v")
            assert apart.select(reason).first()["v"] == "no proof"
            assert bare.select(reason).first()["v"] is None
    records = [("S1-1", name[0], "Lotus Gardens", "India"), ("S2-1", name[0], "Temple Square", "India"), ("S3-1", name[0], "", "India")]
    for profile in ("v11", "v12", "v13"):
        got = engine.match(spark.createDataFrame(records, io.RECORD), profile).first()["matched_entity_ids"]
        assert got == ["S3-1"]


def test_sorted_probe(spark):
    """A v13 target looks its sorted core up only if its core isn't its whole name; a reference record always may."""
    rows = [("S1-1", "beta alpha gamma", "1 x", "India"), ("S2-1", "gamma beta alpha", "1 x", "India"), ("S3-1", "gamma beta alpha ltd", "1 x", "India")]
    df = spark.createDataFrame(rows, io.RECORD)
    for profile, want in (("v12", {"S2-1", "S3-1"}), ("v13", {"S3-1"})):
        p = PROFILES[profile]
        found = blocking.candidates(blocking.with_features(df, p), p).where("channel = 'sorted'")
        assert {r["cid"] for r in found.collect()} == want


def test_candidates_need_a_score(spark):
    """Profiles that index the reference list candidates that scored."""
    rows = [("S1-1", "arav chem", "1 lotus road", "India"), ("S2-1", "zeta foods", "1 lotus road", "India"), ("S2-2", "arav chem", "1 lotus road", "India")]
    got = engine.candidate_lists(spark.createDataFrame(rows, io.RECORD), "v13").first()["candidate_entity_ids"]
    assert got == ["S2-2"]


def test_tiers_and_caps(spark):
    for scores, kept in (([100, 96, 95, 95], (3, 2, 3, 2)), ([92, 91, 90], None), ([90, 86], None), ([85, 85], None)):
        df = spark.createDataFrame([("S1-1", "S2", f"S2-{i}", s) for i, s in enumerate(scores)], "s1 string, src string, cid string, score int")
        got = {p: selection.tiered(df, PROFILES[p].tiers).count() for p in ("v11", "v12", "v13")}
        assert got == {(100, 96, 95, 95): {"v11": 3, "v12": 3, "v13": 3}, (92, 91, 90): {"v11": 2, "v12": 3, "v13": 2}, (90, 86): {"v11": 2, "v12": 2, "v13": 1}, (85, 85): {"v11": 2, "v12": 2, "v13": 1}}[tuple(scores)]
    df = spark.createDataFrame([("S1-1", "S2", f"S2-{i}", 90) for i in range(9)], "s1 string, src string, cid string, score int")
    assert sorted(r["cid"] for r in selection.first_n(df, 5).collect()) == [f"S2-{i}" for i in range(5)]


def test_append_merge_uses_up_places(spark):
    df = spark.createDataFrame([("S1-1", "S2", c, s) for c, s in (("a", 90), ("a", 89), ("b", 80))], "s1 string, src string, cid string, score int")
    assert [r["cid"] for r in selection.top_k_rows(df, 2).collect()] == ["a"] and selection.max_merge(df).count() == 2


def test_metrics(spark):
    t = spark.createDataFrame([("1", ["S2-47", "S3-812"]), ("2", [])], "id string, ids array<string>")
    p = spark.createDataFrame([("1", ["S2-47", "S2-193", "S3-812"])], "id string, ids array<string>")
    counts = metrics.per_entity(p, t)
    assert metrics.included_f(counts).first()["f_half"] == pytest.approx(0.7142857)
    assert metrics.official_f(counts).first()["f_half"] == pytest.approx((0.7142857 + 1) / 2)
    assert metrics.included_f(counts.where("id = '2'")).first()["f_half"] is None
    stray = metrics.per_entity(spark.createDataFrame([("9", ["S2-1"])], "id string, ids array<string>"), t)
    assert {r["id"]: (r["tp"], r["fp"], r["fn"]) for r in stray.collect()} == {"1": (0, 0, 2), "2": (0, 0, 0), "9": (0, 1, 0)}
    assert spark.range(1).select(metrics.promote(F.lit(0.005)), metrics.promote(F.lit(0.0049)), metrics.reproduces(F.lit(0.5), F.lit(0.50009)), metrics.reproduces(F.lit(0.5), F.lit(0.5002))).first()[:] == (True, False, True, False)


def test_sweep(spark):
    scored = spark.createDataFrame([("a", "x", 90), ("a", "y", 80), ("b", "z", 70)], "s1 string, cid string, score int")
    truth = spark.createDataFrame([("a", "x"), ("b", "q")], "s1 string, cid string")
    rows = {r["threshold"]: r for r in metrics.sweep(scored, truth, [70, 80, 90, 100]).collect()}
    assert {t: (r["tp"], r["fp"], r["fn"]) for t, r in rows.items()} == {70: (1, 2, 1), 80: (1, 1, 1), 90: (1, 0, 1), 100: (0, 0, 2)}
    assert [t for t, r in rows.items() if r["best"]] == [90] and rows[100]["f_half"] == 0.0
    none = metrics.sweep(scored.limit(0), truth.limit(0), [80]).first()
    assert (none["tp"], none["fp"], none["fn"], none["best"]) == (0, 0, 0, True)


@pytest.mark.parametrize("profile", ["v01", "v04", "v06", "v12", "v13"])
def test_profile_invariants(spark, profile):
    records = fixtures.part_records(spark, SF).cache()
    p = PROFILES[profile]
    got = {r[0]: r[1] for r in engine.match(records, profile).collect()}
    cand = {r[0]: set(r[1]) for r in engine.candidate_lists(records, profile).collect()}
    country = {r["entity_id"]: r["country"] for r in records.collect()}
    assert set(got) == {k for k in country if k.startswith("S1-")}
    for k, ids in got.items():
        assert len(ids) == len(set(ids)) and all(country[i] == country[k] and not i.startswith("S1-") for i in ids)
        if not p.candidate_cap:
            assert set(ids) <= cand[k]
        if p.tiers:
            assert all(sum(i.startswith(s) for i in ids) <= max(r for r, _ in p.tiers) for s in ("S2-", "S3-"))
    results = spark.createDataFrame(list(got.items()), "source1_entity_id string, matched_entity_ids array<string>")
    assert validation.breaches(results, records.where("entity_id like 'S1-%'").selectExpr("entity_id AS id"), records.selectExpr("entity_id AS id")).count() == 0


def test_io(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"He said ""hi""\nthere"\tx\tUS\nS2-1\tNA\n', encoding="utf-8")
    rows = {r[0]: tuple(r)[1:] for r in io.read_records(spark, str(tmp_path / "a.tsv")).collect()}
    assert rows == {"S1-1": ('He said "hi"\nthere', "x", "US"), "S2-1": ("NA", "", "")}
    df = spark.createDataFrame([("S1-1", ["S2-1", "S3-2"]), ("S1-2", [])], "source1_entity_id string, matched_entity_ids array<string>")
    io.write_lists(df, str(tmp_path / "out"), files=1)
    assert {r[0]: r[1] for r in io.read_lists(spark, str(tmp_path / "out")).collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    io.write_json(df, str(tmp_path / "json"))
    lines = [x for f in sorted((tmp_path / "json").glob("*.json")) for x in f.read_text().splitlines()]
    assert sorted(json.loads(x)["source1_entity_id"] for x in lines) == ["S1-1", "S1-2"]


def _files(tmp_path):
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\nS1-1\ta\nS1-2\tb\nS1-3\tc\n\n")
    (tmp_path / "s2.tsv").write_text("entity_id\tx\nS2-1\ta\nS2-2\tb\n")
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,S1-3\nS1-1\t\nS1-9\tX1,S2-7\nno tab here\n")
    (tmp_path / "good.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\t\nS1-3\tS2-2\n")
    (tmp_path / "cand.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\tS2-2\n")
    (tmp_path / "comma.tsv").write_text("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n")
    (tmp_path / "wrong.tsv").write_text("id\tmatched_entity_ids\nS1-1\tS2-1\n")
    return lambda name: str(tmp_path / name)


def test_validate_files(spark, tmp_path):
    f = _files(tmp_path)
    check = lambda name, **k: validation.validate(spark, f(name), f("s1.tsv"), **k)
    assert check("good.tsv").errors == []
    report = check("good.tsv", candidate=f("cand.tsv"), targets=[f("s2.tsv")])
    assert report.errors == [] and report.warnings == ["matched: warning_not_candidate: 1, e.g. S1-1"]
    rules = {e.split(": ")[1] for e in check("bad.tsv", targets=[f("s2.tsv")]).errors}
    assert rules == {"duplicate_row", "repeated_id", "self_match", "wrong_prefix", "unknown_id", "missing_row", "extra_row", "malformed rows, e.g. no tab here"}
    assert check("comma.tsv").errors == ["matched: comma separated"]
    assert check("wrong.tsv").errors == ["matched: unexpected header ['id', 'matched_entity_ids']"]


def test_command_line(spark, tmp_path, capsys):
    f = _files(tmp_path)
    assert cli.main(["validate", "-m", f("good.tsv"), "-t", f("s1.tsv"), "--check-ids", f("s2.tsv")], spark) == 0
    assert cli.main(["validate", "-m", f("bad.tsv"), "-t", f("s1.tsv")], spark) == 1 and "duplicate_row" in capsys.readouterr().out
    assert cli.main(["prune", f("good.tsv"), "--top", "1", "--output", f("pruned"), "--backup"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"ids_before": 3, "entities": 3, "ids_after": 2, "empty": 1, "pruned": 1}
    assert (tmp_path / "good.tsv.bak").read_text() == (tmp_path / "good.tsv").read_text() and io.backup(spark, f("good.tsv")) is False
    assert cli.main(["evaluate", f("pruned"), f("good.tsv")], spark) == 0
    assert json.loads(capsys.readouterr().out)["totals"] == {"tp": 2, "fp": 0, "fn": 1}
    (tmp_path / "r.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tarav chem\t1 lotus road\tIndia\nS2-1\tArav Chem\t1 Lotus Road\tIndia\n")
    assert cli.main(["match", f("r.tsv"), "--output-dir", f("out")], spark) == 0
    assert io.read_lists(spark, f("out/matching_results")).collect()[0][1] == ["S2-1"]
    assert validation.validate(spark, f("out/matching_results"), f("r.tsv")).errors == ["matched: missing_row: 1, e.g. S2-1"]


def test_subsets(spark):
    df = spark.createDataFrame([(f"S1-{i}", i) for i in range(6)], "entity_id string, v int")
    keep = spark.createDataFrame([("S1-1",), ("S1-5",)], "id string")
    assert sorted(r[1] for r in io.head(df, 3, keep=keep).collect()) == [0, 1, 2, 5] and io.head(df, 2).count() == 2
    a, b = (spark.createDataFrame([(k, v)], "source1_entity_id string, ids string") for k, v in (("S1-1", "x"), ("S1-1", "y")))
    assert [tuple(r) for r in io.side_by_side(a, b).collect()] == [("S1-1", "x", "y")]


def test_lost_pairs(spark):
    """The reasons in their order; a name in another script comes first."""
    s1 = ("S1-1", "arav chem", "5 lotus road", "India")
    others = [("S2-1", "कमल", "5 lotus road", "India"), ("S2-2", "zeta foods", "6 palm", "India"), ("S2-3", "arav foods", "palm", "India"), ("S2-4", "arav foods", "6 palm", "India"), ("S2-5", "arav foods", "5 palm", "India"), ("S2-6", "arav chem", "9 lotus road", "India"), ("S2-7", "arav chem", "5 lotus road", "India")]
    records = spark.createDataFrame([s1, *others], io.RECORD)
    features, scored = engine.scored_pairs(records, "v03")
    truth = spark.createDataFrame([("S1-1", o[0]) for o in others], "s1 string, cid string")
    got = analysis.lost_pairs(analysis.truth_pairs(features, truth), engine.select(scored, PROFILES["v03"]), scored.where("channel <> 'anchor'"))
    assert {r["cid"]: r["outcome"] for r in got.collect()} == {"S2-1": "found", "S2-2": "no_shared_name", "S2-3": "missing_number", "S2-4": "conflicting_number", "S2-5": "fuzzy", "S2-6": "rejected", "S2-7": "found"}
    unseen = analysis.lost_pairs(analysis.truth_pairs(features, truth), scored.limit(0), scored.limit(0))
    assert {r["outcome"] for r in unseen.where("cid = 'S2-1'").collect()} == {"non_latin"}


def test_queries_have_sql_and_rows(spark):
    """Some queries of each kind against their SQL (the driver compares all of them)."""
    import duckdb

    from kindred import queries

    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    with duckdb.connect() as db:
        for t in ("part", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        for name in ("features_v12", "addr_gate_strict", "scores_v13", "candidates_v04", "er_v05_end_to_end", "channel_coverage", "validate_output"):
            df = queries.QUERIES[name](spark, SF)
            cols = sorted(df.columns)
            got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
            rel = db.execute(queries.ORACLE_SQL[name])
            at = [[d[0] for d in rel.description].index(x) for x in cols]
            assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall()), name


def test_stream_equals_batch(spark, tmp_path):
    records = fixtures.part_records(spark, SF).drop("p_brand")
    ref, targets = records.where("entity_id like 'S1-%'"), records.where("entity_id not like 'S1-%'")
    targets.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(targets.schema).parquet(str(tmp_path / "in"))
    matching.write_matches(matching.stream_scores(ref, stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("s1", "src", "cid").agg(F.max("score")).collect()}
    assert got == {tuple(r) for r in selection.max_merge(engine.scored_pairs(records, "v13")[1]).collect()}


def test_trigram_jaccard(spark):
    """The query's rows against its SQL, and against trigrams of the names taken apart here."""
    import duckdb

    from kindred import queries

    got = {(r["s1"], r["cid"]): r["v"] for r in queries.trigram_jaccard(spark, SF).collect()}
    assert len(got) == queries.trigram_jaccard(spark, SF).count() and len({*got.values()}) > 10
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
        want = {(a, b): v for a, b, v in db.execute(queries.ORACLE_SQL["trigram_jaccard"]).fetchall()}
    assert got == pytest.approx(want, abs=1e-12)
    flat = {r["entity_id"]: r["business_name"].lower().replace(" ", "") for r in fixtures.part_records(spark, SF).collect()}
    grams = {k: {t[i : i + 3] for i in range(max(1, len(t) - 2))} for k, t in flat.items()}
    assert all(v == pytest.approx(len(grams[a] & grams[b]) / len(grams[a] | grams[b])) for (a, b), v in got.items())
