"""Known values of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import evaluation as E


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("rate", "line", "want"), [(1, 2.5, 0.0803), (2, 2.5, 0.3233), (2.5, 2.5, 0.4562), (4, 2.5, 0.7619), (2, 1.5, 0.5940), (3, 3.5, 0.3528), (0, 2.5, 0.0), (-1, 2.5, 0.0)])
def test_p_over(spark, rate, line, want):
    assert value(spark, S.p_over(F.lit(float(rate)), line)) == pytest.approx(want, abs=1e-4)


def test_p_over_of_null(spark):
    assert value(spark, S.p_over(F.lit(None).cast("double"))) is None


def test_kelly(spark):
    assert value(spark, S.kelly(F.lit(0.8), F.lit(1.9))) == pytest.approx(0.5778, abs=1e-4)
    assert value(spark, S.kelly(F.lit(0.3), F.lit(1.9))) == 0.0
    assert value(spark, S.kelly(F.lit(0.8), F.lit(1.0))) == 0.0


@pytest.mark.parametrize(("s", "n", "want"), [(82, 128, (0.641, 0.555, 0.719)), (54, 64, (0.844, 0.736, 0.913))])
def test_wilson(spark, s, n, want):
    got = value(spark, S.wilson(F.lit(s), F.lit(n)))
    assert (got["rate"], got["low"], got["high"]) == pytest.approx(want, abs=1e-3)


def test_wilson_of_nothing(spark):
    assert tuple(value(spark, S.wilson(F.lit(0), F.lit(0)))) == (None, None, None)


@pytest.mark.parametrize(("b", "c", "want"), [(5, 0, 0.0625), (1, 1, 1.0), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, want):
    assert value(spark, E.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long"))) == pytest.approx(want)


def test_mcnemar_against_fractions(spark):
    from fractions import Fraction
    from math import comb

    for b, c in ((3, 9), (40, 61), (700, 800)):
        n, k = b + c, min(b, c)
        want = min(Fraction(1), 2 * sum(Fraction(comb(n, i), 2**n) for i in range(k + 1)))
        assert value(spark, E.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long"))) == pytest.approx(float(want), rel=1e-9)


@pytest.mark.parametrize(("p", "want"), [(0.0, 0), (0.3, 2), (0.6, 5), (0.7, 6), (1.0, 9), (1.1, None), (-0.1, None)])
def test_bins(spark, p, want):
    assert value(spark, E.bin_of(F.lit(p), 10)) == want


def test_ece_of_a_constant(spark):
    df = spark.createDataFrame([(1, 0.9, i % 2 == 0) for i in range(100)], "g int, p double, y boolean")
    assert E.ece(df, ["g"], "p", "y").first()["ece"] == pytest.approx(0.4)


@pytest.mark.parametrize(("x", "digits", "want"), [(2.5, 0, 2.0), (0.125, 2, 0.12), (-0.125, 2, -0.12), (115.15, 1, 115.2)])
def test_half_even(spark, x, digits, want):
    assert value(spark, S.half_even(F.lit(x), digits)) == want


def test_texts(spark):
    assert value(spark, S.parse_measure(F.lit("184 cm"))) == 184.0
    assert value(spark, S.parse_measure(F.lit("tall"))) is None
    assert value(spark, S.parse_measure_int(F.lit("18.5"))) == 185
    assert value(spark, S.slug(F.lit("Cote d'Ivoire-B"))) == "cote_divoire_b"
    assert value(spark, S.fmt_or_dash(F.lit(0.0), 1)) == "-"
    assert value(spark, S.fmt_or_dash(F.lit(1234.56), 1)) == "1234.6"
    assert value(spark, S.parse_timestamp(F.lit("2024-01-02T03:04:05"))).hour == 3
    assert value(spark, S.parse_timestamp(F.lit("soon"))) is None
    assert value(spark, S.pct_text(F.lit("55%"))) == 55.0
    assert value(spark, S.anonymise(F.lit("Guinea-Bissau beat Guinea"), F.lit("Guinea"), F.lit("Guinea-Bissau"))) == "Team B beat Team A"
