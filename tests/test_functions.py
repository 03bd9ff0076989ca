"""Scalar formulas (C2-C9) and the spec grid's parameter counts."""

import math

import pytest
from pyspark.sql import functions as F

from trajectra.functions import stats as ST
from trajectra.functions.columns import MODEL_ID_PATTERN, parse_model_id
from trajectra.operators import fit as FT


def test_chi2_tail(spark):
    df = spark.createDataFrame([(22.45, 4), (91.362, 3), (3.84, 1), (0.0, 2), (None, 3), (50.0, 7)], "x double, df int")
    got = [r[0] for r in df.select(ST.chi2_upper("x", "df")).collect()]
    assert got[0] == pytest.approx(0.000163, abs=5e-7)
    assert got[1] == pytest.approx(1.11685e-19, rel=1e-3)
    assert got[2] == pytest.approx(0.05004, abs=1e-5)
    assert got[3] == 1.0 and got[4] is None
    assert got[5] == pytest.approx(1.44449e-08, rel=1e-4)


def test_information_criteria_and_adjusted_lrt(spark):
    df = spark.createDataFrame([(-9217.874, 6, 500, 800.692, 4)], "ll double, p int, n int, x double, dp int")
    r = df.select(ST.aic("ll", "p").alias("aic"), ST.bic("ll", "p", "n").alias("bic"),
                  ST.aicc("ll", "p", "n").alias("aicc"), ST.adjusted_lrt("x", "dp", "n").alias("adj")).first()
    assert r["aic"] == pytest.approx(18447.748, abs=1e-3)
    assert r["bic"] == pytest.approx(18473.035, abs=1e-3)
    assert r["aicc"] == pytest.approx(18447.917, abs=1e-2)
    assert r["adj"] == pytest.approx(769.728, abs=1e-3)


def test_class_share_from_logit(spark):
    from trajectra.operators.compare import class_share
    df = spark.createDataFrame([("m", 1, 1.998), ("m", 2, 0.0)], "m string, k int, logit double")
    s = {r["k"]: r["share"] for r in class_share(df, ["m"]).collect()}
    assert s[1] == pytest.approx(0.8806, abs=1e-4)


@pytest.mark.parametrize("restr,K,p", [(None, 1, 10), ("iq@0", 1, 12), ("iq@0", 4, 24), ("sq@0", 2, 17),
                                       ("sq@0", 4, 25), (" q@0", 2, 19), ("c. i", 2, 20), ("c.is", 2, 22)])
def test_parameter_counts(restr, K, p):
    shared = restr is None
    assert FT.count_parameters(K, (0, 1, 2), restr, shared, 9) == p


def test_parse_model_id(spark):
    names = ["abc-gmm_3 - unconditional quadratic model -  q@0 -2 classes-residuals unconstrained.out",
             "xyz-lgca1 - unconditional linear    model-residuals   constrained.out",
             "x/y/abc-lcga2 - unconditional quadratic model - c. i -4 classes-residuals unconstrained.out"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    parts = parse_model_id(F.col("p"))
    rows = df.select(*[v.alias(k) for k, v in parts.items()]).collect()
    assert (rows[0]["outcome"], rows[0]["family"], rows[0]["restriction"], rows[0]["n_classes"]) == \
        ("abc", "gmm_", "q@0", 2)
    assert (rows[1]["family"], rows[1]["degree"], rows[1]["n_classes"], rows[1]["residuals"]) == \
        ("lgca", "1", 1, "constrained")
    assert (rows[2]["restriction"], rows[2]["n_classes"]) == ("c. i", 4)
    assert MODEL_ID_PATTERN.startswith("^")


def test_chi2_tail_of_many_degrees(spark):
    from math import erfc, exp, factorial, sqrt
    df = spark.createDataFrame([(70.0, 61), (300.0, 200), (0.5, 1), (5.0, 100), (900.0, 200), (1e-6, 3)], "x double, df int")
    got = {(r["x"], r["df"]): r["p"] for r in df.select("x", "df", ST.chi2_upper("x", "df").alias("p")).collect()}
    poisson = lambda x, n: sum(exp(-x / 2) * (x / 2) ** i / factorial(i) for i in range(n // 2))  # noqa: E731  even df
    assert got[(300.0, 200)] == pytest.approx(poisson(300.0, 200), rel=1e-9)
    assert got[(900.0, 200)] == pytest.approx(poisson(900.0, 200), rel=1e-8)
    assert got[(5.0, 100)] == pytest.approx(1.0)
    assert got[(0.5, 1)] == pytest.approx(erfc(sqrt(0.25)), rel=1e-12)
    odd = erfc(sqrt(35.0)) + sum(exp(-35.0 + (i + 0.5) * math.log(35.0) - math.lgamma(i + 1.5)) for i in range(30))
    assert got[(70.0, 61)] == pytest.approx(odd, rel=1e-10) and got[(1e-6, 3)] == pytest.approx(1.0)


def test_name_outside_the_grammar_has_no_class_count(spark):
    r = spark.createDataFrame([("lcga.y.out",)], "p string").select(*[v.alias(k) for k, v in parse_model_id(F.col("p")).items()]).first()
    assert r["n_classes"] is None and r["family"] is None


def test_nested_fits_need_their_keys(spark):
    from trajectra.operators.compare import compare_nested
    f = spark.createDataFrame([("a", -10.0, 2), ("b", -20.0, 2)], "m string, ll double, parameters int")
    with pytest.raises(ValueError):
        compare_nested(f, f)
    assert compare_nested(f, f, ["m"]).count() == 2
