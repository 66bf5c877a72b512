"""Missing values, scores, formatting and the normal CDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a CSV reader takes as missing.
MISSING_TOKENS = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "#N/A", "<NA>", "-nan", "-NaN"]

# Coefficients of the Abramowitz-Stegun 7.1.26 approximation of erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL, the only missing value kept downstream."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def fold_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Canonicalise missing values of all floating columns (or the named ones)."""
    chosen = set(columns or df.columns)
    return df.select(
        *[
            finite_or_null(F.col(quote(f.name))).alias(f.name)
            if f.name in chosen and is_floating(f.dataType)
            else F.col(quote(f.name))
            for f in df.schema.fields
        ]
    )


def quote(name: str) -> str:
    """Column names of flow files hold dots and blanks."""
    return "`" + name.replace("`", "``") + "`"


def binarize(c: Column, benign: str = "benign") -> Column:
    """1 for every class but the benign one; NULL counts as an attack."""
    return F.when(c == F.lit(benign), 0).otherwise(1)


BENIGN_NAME = "benign"


def resolve_benign(classes: list[str], benign: str = BENIGN_NAME) -> str:
    """The class that is benign: the name itself, or the one class that equals it in any case."""
    if benign in classes:
        return benign
    same = [c for c in classes if str(c).lower() == str(benign).lower()]
    if len(same) != 1:
        raise ValueError(f"no class {benign!r} among {sorted(map(str, classes))[:20]}")
    return same[0]


def attack_flag(c: Column, dtype: T.DataType, benign: str = BENIGN_NAME) -> Column:
    """True for an attack: a number other than 0, or a class other than the benign one in any case.

    A NULL number is NULL, a NULL class counts as an attack.
    """
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.lower(c) != F.lit(benign.lower()), F.lit(True))
    return c.cast("boolean") if isinstance(dtype, T.BooleanType) else c != 0


def attack_score(proba: Column, benign: str | None = None, attack: str = "1") -> Column:
    """Score from a class -> probability map: P(attack), or 1 - P(benign) for many classes."""
    if benign is None:
        return F.coalesce(proba[attack], F.lit(0.0))
    return F.lit(1.0) - F.coalesce(proba[benign], F.lit(0.0))


def display_name(key: Column) -> Column:
    """test_f1_score -> F1 Score."""
    return F.initcap(F.replace(F.regexp_replace(key, "^(test_|train_)+", ""), F.lit("_"), F.lit(" ")))


def format_value(v: Column) -> Column:
    """Five decimals, except for small non-zero values, which are kept."""
    return F.when((F.abs(v) < 0.001) & (v != 0), v).otherwise(F.round(v, 5))


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, "[ /]", "_")


def normal_cdf(z: Column) -> Column:
    """P(Z <= z), absolute error below 1e-7 (Spark has no erf)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = reduce(lambda acc, a: (acc + F.lit(a)) * t, reversed(ERF_A), F.lit(0.0))
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2.0).otherwise((F.lit(1.0) - erf) / 2.0)


def flow_start(c: Column, dtype: T.DataType) -> Column:
    """Start of a flow as TIMESTAMP: epoch milliseconds, or any date/time type (naive = UTC)."""
    if is_numeric(dtype):
        return F.timestamp_millis(c.cast("bigint"))
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.timestamp_millis(c.try_cast("bigint")), c.try_cast("timestamp"))
    return c.cast("timestamp")


def micros(c: Column) -> Column:
    """Epoch microseconds; needs a UTC session for naive timestamps."""
    return F.unix_micros(c.cast("timestamp"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))
