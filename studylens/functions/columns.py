"""Column helpers with the null, text and weighting rules of the attempt tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def success() -> Column:
    """Outcome as 0 or 1; NULL stays NULL, so that means skip it."""
    return F.col("data_correct").cast("int")


def success_or_zero() -> Column:
    """Outcome as 0 or 1 for running counts, where NULL is no success."""
    return F.coalesce(success(), F.lit(0))


def sum0(c: Column | str) -> Column:
    """Sum that is 0 over no rows or only NULLs."""
    return F.coalesce(F.sum(c), F.lit(0))


# fixed values: character references of HTML; the ampersand last, so that nothing is read twice
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&agrave;", "à"), ("&acirc;", "â"), ("&ccedil;", "ç"),
    ("&eacute;", "é"), ("&egrave;", "è"), ("&ecirc;", "ê"), ("&euml;", "ë"), ("&icirc;", "î"), ("&iuml;", "ï"), ("&ocirc;", "ô"), ("&ugrave;", "ù"), ("&ucirc;", "û"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&rsquo;", "’"), ("&hellip;", "…"), ("&deg;", "°"), ("&times;", "×"), ("&divide;", "÷"), ("&euro;", "€"), ("&amp;", "&"),
)


def html_text(c: Column) -> Column:
    """Text of marked-up content: references are read, tags go, white space collapses."""
    text = c.cast("string")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return trimmed(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[\s\u00a0]+", " "))


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def real_id(c: Column) -> Column:
    """Id without placeholders: "", none, null and nan in any case become NULL."""
    t = trimmed(c.cast("string"))
    return F.when(~F.lower(t).isin("", "none", "null", "nan"), t)


def real_text(c: Column) -> Column:
    """Blank text becomes NULL; other text stays untrimmed."""
    c = c.cast("string")
    return F.when(trimmed(c) != "", c)


def real_csv(c: Column) -> Column:
    """CSV cell: "", None, none, NULL and null become NULL."""
    t = trimmed(c.cast("string"))
    return F.when(~t.isin("", "None", "none", "NULL", "null"), t)


def real_model(c: Column) -> Column:
    """Model input: "", None, nan, NaN and <NA> become NULL."""
    t = trimmed(c.cast("string"))
    return F.when(~t.isin("", "None", "nan", "NaN", "<NA>"), t)


def outcome(c: Column) -> Column:
    """1.0 for anything above zero, 0.0 otherwise, NULL where it is no number."""
    x = F.when(F.lower(c.cast("string")).isin("true", "false"), (F.lower(c.cast("string")) == "true").cast("double")).otherwise(c.cast("string").try_cast("double"))
    return F.when(x.isNotNull() & ~F.isnan(x), (x > 0).cast("double"))


def code_of(c: Column, level: str) -> Column:
    """Module, objective or activity code at the start of a code; NULL without one."""
    pattern = {"module": r"^(M\d+)", "objective": r"^(M\d+O\d+)", "activity": r"^(M\d+O\d+A\d+)"}[level]
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found)


def count_with_null(name: str) -> Column:
    """Distinct values where NULL counts as one."""
    return F.count_distinct(name) + F.coalesce(F.max(F.col(name).isNull().cast("int")), F.lit(0))


def rate(c: Column) -> Column:
    return F.avg(c.cast("double"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def logistic(item: Column, student: Column) -> Column:
    """Expected success on the rating scale of 400 points per factor ten."""
    return 1 / (1 + F.pow(F.lit(10.0), (item - student) / 400))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, erfc(|z| / sqrt 2), to about 14 digits.

    Below 2 by the power series of erf, beyond by the continued fraction of erfc, both
    folded over a fixed number of terms.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    term = lambda acc, n: F.struct((acc["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * x * x / (2 * n + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), term, lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), x, lambda acc, n: x + n / 2 / acc)
    density = F.exp(-x * x) / F.sqrt(F.lit(math.pi))
    return F.when(x < 2, 1 - 2 * density * series).otherwise(density / fraction)


def two_proportion_z(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """z of the difference of two proportions with pooled variance; NULL without variance."""
    pooled = (s1 + s2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when(error > 0, (s1 / n1 - s2 / n2) / error)
