"""Distribution functions against the mathematics library on Spark's own class path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.functions import special


@pytest.fixture(scope="module")
def jvm(spark):
    return spark.sparkContext._jvm.org.apache.commons.math3


@pytest.mark.parametrize("df", [1.0, 2.0, 5.0, 33.0, 1e4])
def test_t_tails(jvm, df):
    ts = np.array([0.0, 0.3, 1.0, 2.5, 8.0, -1.7])
    law = jvm.distribution.TDistribution(df)
    want = [2 * law.cumulativeProbability(-abs(float(t))) for t in ts]
    np.testing.assert_allclose(special.t_two_sided(ts, np.full(6, df)), want, rtol=1e-8, atol=1e-14)


def test_t_tails_of_very_many_degrees_of_freedom():
    """There the class-path library loses digits itself, so the normal expansion is the measure."""
    t, df = 2.5, 6e7
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    want = math.erfc(t / math.sqrt(2)) + 2 * density * (t**3 + t) / (4 * df)
    assert float(special.t_two_sided(t, df)) == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize("df1,df2", [(1.0, 5.0), (3.0, 40.0), (7.0, 9_998.0)])
def test_f_tails_and_quantiles(jvm, df1, df2):
    law = jvm.distribution.FDistribution(df1, df2)
    fs = np.array([0.01, 0.5, 1.0, 3.0, 20.0])
    np.testing.assert_allclose(special.f_upper(fs, df1, df2), [1 - law.cumulativeProbability(float(f)) for f in fs], atol=1e-10)
    assert float(special.f_quantile(0.95, df1, df2)) == pytest.approx(law.inverseCumulativeProbability(0.95), rel=1e-7)


def test_t_quantile(jvm):
    assert float(special.t_quantile(0.975, 12.0)) == pytest.approx(jvm.distribution.TDistribution(12.0).inverseCumulativeProbability(0.975), rel=1e-8)


def test_gamma_functions(jvm):
    xs = np.array([0.01, 0.5, 1.0, 3.7, 80.0, 1e6])
    # The library's digamma is good to about 1e-8; exact values below check the rest of the digits.
    np.testing.assert_allclose(special.digamma(xs), [jvm.special.Gamma.digamma(float(x)) for x in xs], rtol=1e-8)
    euler = 0.57721566490153286061
    np.testing.assert_allclose(special.digamma([1.0, 0.5, 2.0]), [-euler, -euler - 2 * math.log(2), 1 - euler], rtol=1e-12)
    np.testing.assert_allclose(special.trigamma([1.0, 0.5]), [math.pi**2 / 6, math.pi**2 / 2], rtol=1e-11)
    np.testing.assert_allclose(special.trigamma(xs), [jvm.special.Gamma.trigamma(float(x)) for x in xs], rtol=1e-7)
    np.testing.assert_allclose(special.log_gamma(xs), [math.lgamma(x) for x in xs])


def test_normal_functions(jvm):
    law = jvm.distribution.NormalDistribution()
    ps = np.array([1e-6, 0.02, 0.5, 0.9, 0.999])
    np.testing.assert_allclose(special.normal_quantile(ps), [law.inverseCumulativeProbability(float(p)) for p in ps], atol=1e-9)
    assert float(special.normal_two_sided(1.959963984540054)) == pytest.approx(0.05)
    assert float(special.normal_upper(1.959963984540054)) == pytest.approx(0.025)


def test_udfs_keep_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (2.0, None)], "t double, df double")
    got = [r[0] for r in df.select(special.t_two_sided_udf("t", "df")).collect()]
    assert got[0] == pytest.approx(0.36321746764912) and got[1:] == [None, None]
    assert [r[0] for r in df.select(special.normal_quantile_udf(F.col("t") / 4)).collect()][1] is None
