import math

import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import binning as bn
from riskloom.operators import cleaning as cl
from riskloom.operators import encoding as en
from riskloom.operators.features import feature_steps
from riskloom.schemas import RECORD

INF = float("inf")


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(-1, 1), (0, 2), (1, 3)], "A int, B int")


@pytest.mark.parametrize("stage", [bn.Discretizer(n_bins=3), bn.QuantileDiscretizer(n_bins=3)])
def test_bins_of_three_rows(ab, stage):
    out = stage.fit(ab).transform(ab).orderBy("A").collect()
    assert [(r["A__bin"], r["B__bin"]) for r in out] == [("0.0", "0.0"), ("1.0", "1.0"), ("2.0", "2.0")]


def test_custom_bins_are_right_closed(ab):
    stage = bn.CustomDiscretizer(bins={"A": [-INF, 0, INF], "B": [-INF, 1, INF]}, inplace=True)
    out = stage.fit(ab).transform(ab).orderBy("B", "A").collect()
    assert [(r["A"], r["B"]) for r in out] == [("0.0", "0.0"), ("0.0", "1.0"), ("1.0", "1.0")]


def test_missing_and_outside_values_are_bin_zero(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (99.0,), (6.0,)], "x double")
    out = bn.CustomDiscretizer(bins={"x": [0, 5, 10]}).fit(df).transform(df)
    assert [r["x__bin"] for r in out.collect()] == ["0.0", "0.0", "0.0", "0.0", "1.0"]


def test_equal_quantile_edges_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    assert bn.QuantileDiscretizer(n_bins=4).fit(df).fitted("edges")["x"] == [-INF, 1.0, INF]


def test_rare_events(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "A string, B string")
    model = bn.BinRareEvents(min_ratio=0.5).fit(df)
    assert sorted(tuple(r) for r in model.transform(df).collect()) == [("OTHERS", "OTHERS"), ("a", "OTHERS"), ("a", "OTHERS")]
    unseen = spark.createDataFrame([("zz", None)], "A string, B string")
    assert tuple(model.transform(unseen).first()) == ("OTHERS", "OTHERS")


@pytest.fixture(scope="module")
def xy(spark):
    return spark.createDataFrame([("a", "c", 1), ("a", "d", 1), ("b", "d", 0)], "A string, B string, y int")


def test_target_encoder(xy):
    out = en.TargetEncoder(target="y").fit(xy).transform(xy).collect()
    assert sorted((r["A"], r["B"]) for r in out) == [(0.0, 0.5), (1.0, 0.5), (1.0, 1.0)]


def test_weight_of_evidence(xy):
    out = en.WOEEncoder(target="y").fit(xy).transform(xy).collect()
    got = sorted((round(r["A"], 6), round(r["B"], 6)) for r in out)
    assert got == [(0.0, -0.693147), (0.0, -0.693147), (0.0, 0.0)]


MULTI = [("Q", "Q", "Q", 1), ("Q", "Q", "Q", 2), ("Q", "W", "Q", 3), ("W", "W", "Q", 4), ("W", "W", "W", 5), ("W", "W", "W", 6)]
EXPECTED = [
    [1.0, 0, 0, -0.405465, 0, 0, -0.405465],
    [2.0, 0, 0, -0.405465, 0, 0, -0.405465],
    [3.0, 0, 0.693147, -0.405465, 0, 0.693147, -0.405465],
    [4.0, 0, 0.693147, -0.405465, 1.386294, 0.693147, -0.405465],
    [5.0, 0, 0.693147, 0.693147, 1.386294, 0.693147, 0.693147],
    [6.0, 0, 0.693147, 0.693147, 1.386294, 0.693147, 0.693147],
]


def multi(spark, target, kind):
    data = [(*r, y) for r, y in zip(MULTI, target)]
    return spark.createDataFrame(data, f"A string, B string, C string, D int, TARGET {kind}")


def check_multi(out):
    names = ["D"] + [f"{c}__TARGET_{k}_WOEEncoder" for k in (1, 2) for c in "ABC"]
    assert [c for c in out.columns if c != "TARGET"] == names
    got = [[round(v, 6) for v in r] for r in out.select(*names).orderBy("D").collect()]
    assert got == EXPECTED


def test_multiclass_encoder(spark):
    df = multi(spark, [0, 0, 1, 2, 1, 2], "int")
    check_multi(en.MultiClassEncoder(encoder="WOEEncoder").fit(df).transform(df))


def test_regression_encoder(spark):
    df = multi(spark, [0.11, -0.1, 5.55, 233.9, 4.66, 255.1], "double")
    check_multi(en.RegressionEncoder(encoder="WOEEncoder", discretizer="quantile", n_bins=3).fit(df).transform(df))


def test_encoder_checks(spark, xy):
    with pytest.raises(ValueError, match="both 0 and 1"):
        en.TargetEncoder(target="y").fit(xy.withColumn("y", F.lit(3)))
    with pytest.raises(ValueError, match="missing"):
        en.WOEEncoder(target="y").fit(xy.withColumn("A", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="three classes"):
        en.MultiClassEncoder(target="y").fit(xy)
    with pytest.warns(UserWarning):
        numbers = xy.select("y", F.lit(1).alias("n"))
        assert en.TargetEncoder(target="y").fit(numbers).transform(numbers).columns == ["y", "n"]


def test_unseen_category_is_an_error_by_default(spark, xy):
    model = en.TargetEncoder(target="y").fit(xy)
    new = spark.createDataFrame([("zz", "c", 1)], xy.schema)
    with pytest.raises(Exception, match="unseen category in A: zz"):
        model.transform(new).collect()


def test_out_of_fold_score_never_uses_the_own_fold(spark):
    data = [(i, "g" if i % 3 else "h", float(i % 17)) for i in range(200)] + [(200, "single", 5.0), (201, None, 2.0)]
    df = spark.createDataFrame(data, "k long, g string, r double")
    stage = en.OOFGroupEncoder(group_col="g", score_col="s", loss_ratio_col="r", key="k")
    folds = {r["k"]: r["__fold"] for r in stage._folded(df).collect()}
    pdf = pd.DataFrame(data, columns=["k", "g", "r"])
    pdf["f"] = pdf["k"].map(folds)
    for row in stage.out_of_fold(df).collect():
        rest = pdf[pdf["f"] != folds[row["k"]]]
        own = rest[rest["g"] == row["g"]]
        assert row["s"] == pytest.approx((own if len(own) else rest)["r"].mean())
    model = stage.fit(df)
    out = {r["g"]: r["s"] for r in model.transform(spark.createDataFrame([(1, "g", None), (2, "new", None)], df.schema)).collect()}
    assert out["g"] == pytest.approx(pdf[pdf["g"] == "g"]["r"].mean()) and out["new"] == pytest.approx(pdf["r"].mean())


def test_one_hot_names_do_not_collide(spark):
    df = spark.createDataFrame([("a",), ("B",), ("b",)], "c string")
    out = en.CategoricalEncoder(nominal_cols=["c"]).fit(df).transform(df)
    assert out.columns == ["c_a", "c_b"] and len(out.collect()) == 3


RECORDS = [
    (f"REC_{i:04d}", [" cyber ", "marine", "Cyber", None][i % 4], ["UK", "EU ", "US"][i % 3], ["retail", None][i % 2], 1_000_000 + i, [0, 5_000][i % 2],
     ["Meridian Re", "nan"][i % 5 == 0], [None, 1.0, -2.0][i % 3], [None, -3.0, 12.0, 4.0][i % 4], (i % 13) / 6.0, i % 13 > 6)
    for i in range(60)
]


def test_feature_steps_round_trip(spark, tmp_path):
    train = spark.createDataFrame(RECORDS, RECORD)
    model, x = feature_steps().fit_transform(train.drop("is_loss_making"))
    assert x.count() == 60 and "loss_ratio" not in x.columns and "risk_type_marine" in x.columns
    assert x.where("years_trading_invalid = 1").count() == 15 and x.where("prior_claims_missing = 1").count() == 20
    numbers = [f.name for f in x.schema.fields if f.name != "record_id"]
    assert x.where(" OR ".join(f"`{c}` IS NULL" for c in numbers)).count() == 0
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(train.drop("is_loss_making"))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, model.transform(train.drop("is_loss_making")).collect()), key=repr)


def test_cleaning_of_single_values(spark):
    df = spark.createDataFrame([(" cyber ", " x", "nan"), (None, "  ", "<na>")], "a string, b string, c string")
    out = cl.StringCleaner(categorical_cols=["a", "c"]).transform(df).collect()
    assert [tuple(r) for r in out] == [("cyber", "x", "Unknown"), ("Unknown", "", "Unknown")]


def test_imputer_floors_do_not_fill(spark):
    df = spark.createDataFrame([(None, -3.0, None, 0.0), (-1.0, None, 10.0, None), (2.0, 5.0, 30.0, 8.0)], "prior_claims double, years_trading double, premium double, limit double")
    out = cl.NumericImputer().fit(df).transform(df).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0, 20.0, 1.0), (0.0, 2.5, 10.0, 4.0), (2.0, 5.0, 30.0, 8.0)]


def test_label_errors(spark):
    good = spark.createDataFrame([(" TRUE",), ("false",)], "y string")
    assert [r["y"] for r in cl.normalise_label(good, "y").collect()] == [True, False]
    with pytest.raises(ValueError, match="maybe"):
        cl.normalise_label(spark.createDataFrame([("true",), ("maybe",)], "y string"), "y")
    with pytest.raises(ValueError, match="missing"):
        cl.normalise_label(spark.createDataFrame([("true",), (None,)], "y string"), "y")


def test_request_validation(spark):
    lines = ['{"record_id":"A","limit":5,"zone":"x"}', '{"limit":"5"}', '{"limit":null}', "[1]", "not json"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, payload string")
    out = {r["i"]: r for r in cl.validate_requests(df, "payload").collect()}
    assert out[0]["limit"] == 5.0 and out[0]["extras"] == {"zone": "x"} and out[0]["reasons"] == []
    assert out[1]["reasons"] == ["wrong_type:limit"] and out[2]["reasons"] == []
    assert out[3]["reasons"] == ["not_an_object"] and "not_an_object" in out[4]["reasons"]


def test_padding_warns(spark):
    r = cl.pad_features(spark.createDataFrame([(1, 2)], "id int, a int"), ["a", "b"]).first()
    assert (r["a"], r["b"], r["model_warnings"]) == (2, 0, ["feature_missing_after_transform:b"])


def test_experience_bands(spark):
    df = spark.createDataFrame([(v, 1.0, 1.0, 1.0) for v in (0.0, 3.0, 3.5, 25.0, 26.0, None)], "years_trading double, premium double, limit double, prior_claims double")
    got = [r["experience_band"] for r in cl.FeatureEngineer().transform(df).collect()]
    assert got == ["startup", "startup", "early", "established", "mature", "nan"]
    assert math.isclose(cl.FeatureEngineer().transform(df).first()["log_limit"], math.log(2))


def test_simple_imputers(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, "x", None), (None, "y", None), (4.0, "y", None)], "n double, s string, d date")
    fill = lambda s: [r["n"] for r in cl.SimpleNumericImputer(strategy=s).fit(df).transform(df).collect()][2]
    assert (fill("mean"), fill("median"), fill("most_frequent"), fill("constant")) == (2.0, 1.0, 1.0, 0.0)
    assert str(cl.SimpleDatetimeImputer().transform(df).first()["d"]) == "1970-01-01"
    assert cl.SimpleCategoryImputer().transform(df).first()["s"] == "None"
