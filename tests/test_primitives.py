import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import islands, quantiles, sampling, sequences


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 20, n))
    pdf = pd.DataFrame({"k": key, "o": rng.permutation(n), "x": np.round(rng.normal(size=n), 2)})
    pdf["mark"] = np.where(rng.random(n) < 0.01, pdf["x"], np.nan)
    df = spark.createDataFrame(pdf).withColumn("mark", F.nanvl("mark", F.lit(None).cast("double")))
    return pdf.sort_values(["k", "o"]).reset_index(drop=True), df


@pytest.mark.parametrize("how", ["plain", "sampled chunks", "given chunks"])
def test_sequences_match_a_sorted_scan(rows, how):
    pdf, df = rows
    options = {
        "plain": {}, "sampled chunks": {"small_group": 10},
        "given chunks": {"chunk": F.floor(F.col("o") / 97).cast("int")},
    }[how]
    got = sequences.previous_row(df, ["k"], ["o"], ["x"], **options).select("k", "o", "prev.x").toPandas()
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    want = pdf.groupby("k")["x"].shift(1)
    assert np.allclose(got["x"].to_numpy(float), want.to_numpy(float), equal_nan=True)

    got = sequences.row_numbers(df, ["k"], ["o"], **options).toPandas().sort_values(["k", "o"])
    assert got["idx"].tolist() == pdf.groupby("k").cumcount().tolist()

    got = sequences.running_last(df, ["k"], ["o"], "mark", name="last", **options).toPandas().sort_values(["k", "o"])
    assert np.allclose(got["last"].to_numpy(float), pdf.groupby("k")["mark"].ffill().to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("small_group, accuracy", [(0, 10_000), (0, 50), (10**6, 50)])
def test_quantiles_are_exact(spark, rows, small_group, accuracy):
    pdf, df = rows
    wanted = {"a": ("x", 0.5), "b": ("x", 0.01), "c": ("o", 0.85), "d": ("x", 1.0), "e": ("x", 0.0)}
    got = quantiles.exact_quantiles(df, ["k"], wanted, small_group=small_group, accuracy=accuracy).toPandas().set_index("k")
    for name, (column, p) in wanted.items():
        want = pdf.groupby("k")[column].quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index(), atol=1e-12)


def test_quantiles_skip_non_finite(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, "nan", "inf", "-inf")], "k int, x double")
    for small in (0, 10):
        assert quantiles.exact_quantiles(df, ["k"], {"m": ("x", 0.5)}, small_group=small).first()["m"] == 2.0


@pytest.mark.parametrize("depths, kept", [
    ([2, 2.01, 2.02, 2.03, 5, 5.01], (2.0, 2.03, 4)), ([2, 2.01, 5, 5.01], (2.0, 2.01, 2)),
])
def test_dominant_depth_run(spark, depths, kept):
    df = spark.createDataFrame([(1, float(v)) for v in depths], "id int, d double")
    row = islands.dominant_run(islands.value_runs(df, ["id"], "d", 0.15), ["id"]).first()
    assert (row["lo"], row["hi"], row["n"]) == kept


def test_runs_match_a_sorted_scan(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 800), "v": np.round(rng.uniform(-40, 40, 800), 2)})
    got = islands.value_runs(spark.createDataFrame(pdf), ["k"], "v", 0.25).toPandas()
    for k, values in pdf.groupby("k")["v"]:
        ordered = np.sort(values.to_numpy())
        pieces = np.split(ordered, np.flatnonzero(np.diff(ordered) > 0.25) + 1)
        want = [(p[0], p[-1], len(p)) for p in pieces]
        mine = got[got["k"] == k].sort_values("lo")[["lo", "hi", "n"]]
        assert [tuple(r) for r in mine.to_numpy()] == [tuple(map(float, w)) for w in want]


def test_decimate_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 4000, 0).otherwise(1))
    first = sampling.decimate(df, ["k"], 1000, ["id"]).toPandas()
    again = sampling.decimate(df.repartition(7), ["k"], 1000, ["id"]).toPandas()
    assert first.groupby("k").size().to_dict() == {0: 1000, 1: 1000}
    assert set(first["id"]) == set(again["id"])
    assert set(first["id"]) != set(sampling.decimate(df, ["k"], 1000, ["id"], seed=1).toPandas()["id"])
    assert sampling.decimate(df, ["k"], 0, ["id"]).count() == 5000
