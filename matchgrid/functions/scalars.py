"""Scalar functions as Columns: null in, null out, unless said otherwise; no division raises."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded to so many places, ties to even, by scaling (2.5 to 2, 115.15 to 115.2 at one place)."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def half_even_of_sum(x: Column, digits: int = 0) -> Column:
    """``half_even(F.round(x, 9), digits)``, which hides the order of addition, at a fraction of its time.

    The rounding to nine places goes through decimals, and only next to a tie can it change the result:
    it moves ``x`` in units of ``digits`` by less than 1e-6, as long as these are fewer than 1e9.
    """
    units = x * F.lit(float(10**digits))
    plain = (F.abs(units) < F.lit(1e9)) & (F.abs(units - F.floor(units) - F.lit(0.5)) > F.lit(1e-6))
    return F.when(plain, half_even(x, digits)).otherwise(half_even(F.round(x, 9), digits))


def result_from_score(home: Column, away: Column) -> Column:
    return F.when(home > away, "home_win").when(home < away, "away_win").when(home == away, "draw")


def over_under(total: Column, line: float) -> Column:
    """A total on the line counts as under."""
    return F.when(total > line, "over").when(total.isNotNull(), "under")


def p_over(rate: Column, line: float = 2.5) -> Column:
    """Probability that a Poisson count of this mean exceeds the line; 0 for means of 0 or less."""
    k = math.floor(line)
    term, total = F.exp(-rate), F.exp(-rate)
    for i in range(1, k + 1):
        term = term * rate / F.lit(float(i))
        total = total + term
    return F.when(rate <= 0, F.lit(0.0)).when(rate.isNotNull(), F.least(F.greatest(F.lit(1.0) - total, F.lit(0.0)), F.lit(1.0)))


def kelly(p: Column, odds: Column) -> Column:
    """Kelly fraction at decimal odds, never below 0."""
    b = odds - F.lit(1.0)
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.greatest(F.try_divide(b * p - (F.lit(1.0) - p), b), F.lit(0.0)))


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """Struct of rate, low and high of the Wilson interval; nulls if n is 0."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    s, m = successes.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = F.try_divide(s, m)
    denominator = F.lit(1.0) + F.try_divide(F.lit(z * z), m)
    centre = F.try_divide(p + F.try_divide(F.lit(z * z), F.lit(2.0) * m), denominator)
    half = F.try_divide(F.lit(z) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), m) + F.try_divide(F.lit(z * z), F.lit(4.0) * m * m)), denominator)
    low, high = F.when(m.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(m.isNotNull(), F.least(F.lit(1.0), centre + half))
    return F.struct(p.alias("rate"), low.alias("low"), high.alias("high"))


def parse_measure(text: Column) -> Column:
    """'184 cm' or '80 kg' as a number; null if it isn't one."""
    return F.regexp_replace(F.trim(text), " ?(cm)?(kg)?$", "").try_cast("double")


def parse_measure_int(text: Column) -> Column:
    """The digits of the text as one integer, so that '18.5' gives 185."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), " -'", "__")


def fixed_places(x: Column, decimals: int) -> Column:
    """A number with so many decimals (half to even), as ``format_string`` shows it, put together from whole numbers."""
    scale = F.lit(float(10**decimals))
    units = F.rint(x * scale)
    whole = F.floor(units / scale)
    rest = (units - whole.cast("double") * scale).cast("bigint").cast("string")
    plain = (units >= 0) & (x > 0) & (units < F.lit(1e15))
    return F.when(plain, F.concat(whole.cast("string"), F.lit("."), F.lpad(rest, decimals, "0"))).otherwise(F.format_string(f"%.{decimals}f", half_even(x, decimals)))


def fmt_or_dash(x: Column, decimals: int, whole: bool = False) -> Column:
    """A number with decimals (half to even), '-' for null and 0; ``whole``: as an integer."""
    if whole:
        shown = x.cast("bigint").cast("string")
    elif decimals == 0:
        shown = half_even(x).cast("bigint").cast("string")
    else:
        shown = fixed_places(x, decimals)
    return F.when(x.isNull() | (x == 0), F.lit("-")).otherwise(shown)


def parse_timestamp(text: Column) -> Column:
    """Date, date and time, or the form with T, in UTC; null if it is none of them."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "T", " "))


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def pct_text(text: Column) -> Column:
    """'55%' or '55' as a number."""
    return F.regexp_replace(text, "%", "").try_cast("double")


def stat_key(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("_")), F.lit("%"), F.lit("pct"))


def anonymise(text: Column, home: Column, away: Column) -> Column:
    """Whole team names replaced, the longer name first."""
    home_first = F.replace(F.replace(text, home, F.lit("Team A")), away, F.lit("Team B"))
    away_first = F.replace(F.replace(text, away, F.lit("Team B")), home, F.lit("Team A"))
    return F.when(F.length(home) >= F.length(away), home_first).otherwise(away_first)


def ratio(a: Column, b: Column, scale: float = 1.0, digits: int | None = None, otherwise: Column | None = None) -> Column:
    """a / b * scale where b > 0, rounded half to even; else null or ``otherwise``."""
    value = F.try_divide(a.cast("double"), b.cast("double")) * F.lit(float(scale))
    value = value if digits is None else half_even(value, digits)
    return F.when(b > 0, value).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)
