"""Column expressions shared by the operators; all built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that clean_strings takes as missing (fixed values).
NULL_WORDS = ["nan", "NaN", "Nan", "null", "Null"]
#: Values that recognize_missing takes as missing (fixed values).
MISSING_TOKENS = ["?", "NA", "N/A", "na", "n/a", "nan", "NaN", "-", "--", "", " ", "null", "NULL", "None", "NONE", "missing", "MISSING", "unknown", "UNKNOWN"]
#: Values that type inference takes as missing (fixed values).
INFERENCE_NULLS = ["", " ", "null", "NaN", "nan", "None", "?"]

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE = r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4})([ T]\d{1,2}:\d{2}(:\d{2})?)?\s*$"
#: Tried in turn: ISO, month first, day first.
DATE_FORMATS = ["yyyy-M-d", "yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss", "yyyy/M/d", "M/d/yyyy", "M/d/yyyy H:mm:ss", "M-d-yyyy", "d/M/yyyy", "d/M/yyyy H:mm:ss", "d-M-yyyy", "d.M.yyyy"]


def squeeze(c: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def to_number(c: Column) -> Column:
    """The number that a text spells, else null; no suffixes, no hexadecimals, no infinities."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def to_date(c: Column) -> Column:
    """The timestamp that a text spells, month first before day first, else null."""
    text = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def not_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
