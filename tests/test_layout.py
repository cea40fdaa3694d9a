"""The two-level layouts give what a plain window gives, on a series that holds most rows."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import layout as L
from tickloom.functions import rolling as R
from tickloom.functions.session import in_ranges
from tickloom.operators.metrics import rank_history


@pytest.fixture(scope="module")
def skewed(spark):
    """One ticker with two thirds of the rows, ties in value, several rows per day."""
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("T"), (F.col("id") % 7).cast("string"))).otherwise("HOT").alias("ticker"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3607).alias("ts"),
        F.col("id"),
        F.when(F.col("id") % 11 != 0, ((F.col("id") * 7919) % 101 - 50).cast("double") / 7).alias("x"),
    )
    return base.persist()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_positions(skewed):
    plain = skewed.select("id", F.row_number().over(Window.partitionBy("ticker").orderBy("ts")).alias("pos"))
    assert rows(plain) == rows(L.positions(skewed, ["ticker"], ["ts"]).select("id", "pos"))


@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_blocked_frames(skewed, size):
    def build(df, w):
        return df.select("id", F.sum("x").over(w.rowsBetween(-4, 2)).alias("s"), F.lag("x", 5).over(w).alias("l"), *[c for c in df.columns if c.startswith("_")])

    plain = L.over_series(skewed, build, shape=L.DAILY)
    cut = L.over_series(skewed, build, before=5, after=2, rows=size)
    a, b = plain.toPandas().sort_values("id"), cut.toPandas().sort_values("id")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b[a.columns].reset_index(drop=True))


def test_running(skewed):
    aggs = {"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")),
            "p": ("product", 1 + F.col("x") / 100), "last": ("last", F.col("x"))}
    a = L.running(skewed, ["ticker"], ["ts"], aggs, L.DAILY).toPandas().sort_values("id").reset_index(drop=True)
    b = L.running(skewed, ["ticker"], ["ts"], aggs).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)


def test_ranks(skewed):
    small = L.Shape(stamp_rows=10_000)
    a = L.avg_rank(skewed, "x", ["ticker"], "r", True, small).select("id", "r")
    b = L.avg_rank(skewed, "x", ["ticker"], "r", True).select("id", "r")
    assert rows(a) == rows(b)
    expected = skewed.toPandas().groupby("ticker")["x"].rank(pct=True)
    got = b.toPandas().sort_values("id")["r"].reset_index(drop=True)
    pd.testing.assert_series_equal(got, expected.reset_index(drop=True), check_names=False)


def test_grouped_map_blocks(skewed):
    """An exponential average computed in blocks equals the one over the whole series."""
    def ema(pdf):
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "e": pdf["x"].fillna(0.0).ewm(alpha=0.2, adjust=False).mean().to_numpy()})

    whole = L.apply_series(skewed, ema, "id long, e double", shape=L.DAILY).toPandas().sort_values("id")["e"].to_numpy()
    cut = L.apply_series(skewed, ema, "id long, e double", before=200, rows=300).toPandas().sort_values("id")["e"].to_numpy()
    assert abs(whole - cut).max() < 1e-12


def test_cross_ranks_two_level(spark, tables):
    from catalog.intraday import RANK_ON, _related
    from tickloom.operators.intraday import cross_ranks

    frame = _related(tables).select("ticker", "ts", *[F.round(c, 9).alias(c) for c in RANK_ON]).persist()
    names = [f"xs_rank_{c}" for c in RANK_ON]
    a = cross_ranks(frame, RANK_ON, shape=L.Shape(stamp_rows=1000)).select("ticker", "ts", *names)
    b = cross_ranks(frame, RANK_ON).select("ticker", "ts", *names)
    assert rows(a) == rows(b)


def test_partition_count_does_not_matter(spark, folder):
    import __spark_entry__ as entry

    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(entry.queries()["l13_label_shuffle"](spark, folder)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_ranks_are_dealt_by_ranges(spark):
    """Scores that crowd around a half, in two groups that span all ranges and many that span none, have the ranks of a plain window."""
    scores = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, -1.0).otherwise(0.5 + (F.col("id") * 7919 % 6000) / 2e7).alias("v"),
        F.when(F.col("id") % 10 < 4, "a").when(F.col("id") % 10 < 8, None).otherwise((F.col("id") % 90).cast("string")).alias("k"),
        F.lit(2).alias("cnt"), (F.col("id") % 5).alias("m"),
    ).groupBy("k", "v").agg(F.sum("cnt").alias("cnt"), F.sum("m").alias("m"))
    columns = ["k", "v", "cnt", "below", "avg_rank", "n", "below_m", "avg_rank_m", "n_m"]
    whole = L.value_ranks(scores, "v", ["k"], shape=L.Shape(stamp_rows=10_000), also=["m"])
    assert rows(whole.select(*columns)) == rows(L.value_ranks(scores, "v", ["k"], also=["m"]).select(*columns))
    every = L.value_ranks(scores.groupBy("v").agg(F.sum("cnt").alias("cnt")), "v").toPandas().sort_values("v")
    assert (every["below"] == every["cnt"].cumsum() - every["cnt"]).all() and set(every["n"]) == {12000}
    assert L.value_ranks(scores.limit(0), "v", ["k"]).collect() == []


def test_rows_of_a_range_are_bounded(spark):
    """A value that a third of the rows has is one row of the counts; the others part evenly, however close they are."""
    rows_ = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.5 + F.rand(3) * 1e-9).alias("v"))
    counts = rows_.groupBy("v").agg(F.count("*").alias("cnt"))
    placed = in_ranges(counts, ["v"]).groupBy(F.shiftright("_at", 33)).count().toPandas()["count"]
    assert placed.sum() == counts.count() and len(placed) > 1 and placed.max() <= 2 * placed.sum() / len(placed)


def test_rank_history_of_unbounded_groups(spark):
    rows_ = [("e", i % 3, f"t{i}", None if i % 7 == 0 else float(i * 37 % 11)) for i in range(500)] + [(None, 1, "x", 1.0)]
    df = spark.createDataFrame(rows_, "experiment_id string, ts int, ticker string, prediction double")
    bounded, free = rank_history(df, shape=L.Shape(stamp_rows=1000)), rank_history(df)
    assert rows(bounded) == rows(free) and free.columns == [*df.columns, "rank_pct", "rank_order"]
    expected = df.toPandas().groupby(["experiment_id", "ts"], dropna=False)["prediction"].rank(pct=True)
    got = free.toPandas().merge(df.toPandas().assign(want=expected)[["ticker", "want"]], on="ticker")
    pd.testing.assert_series_equal(got["rank_pct"], got["want"], check_names=False)
