"""Block rates of url_filter over all labelled urls."""

from pyspark.sql import functions as F

from kindred.llm import url_filter


def test_rates_of_all_suffixes(spark):
    """300 suffixes, and a sample of 50 of 1,500 labelled urls: each suffix still has its own rate."""
    rows = [(f"http://h.d{i}.x{i}/p{j}", "block" if j < i % 6 else "allow") for i in range(300) for j in range(5)]
    df = spark.createDataFrame(rows, "url string, verdict string").repartition(3)
    host, path = url_filter.host_and_path(F.col("url"))
    df = url_filter.lexical(df.withColumns({"host": host, "path": path}))
    model = url_filter.fit(df, 50)
    blocked = sum(v == "block" for _, v in rows)
    prior = (blocked + 0.5) / (len(rows) + 2)
    got = model.with_suffix_rates(df).collect()
    assert len(got) == len(rows) and model.trees
    for r in got:
        want = (int(r["s1"][1:]) % 6 + prior) / 6
        assert abs(r["suffix1"] - want) < 1e-9 and abs(r["suffix2"] - want) < 1e-9
