"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS = 1_000_000_000
# Behaviour names, their codes, their rank among equal times, and their weights by code.
CODES = {"pv": 0, "cart": 1, "fav": 2, "buy": 3}
TIE_ORDER = {"pv": 0, "fav": 1, "cart": 2, "buy": 3}
WEIGHTS = (1.0, 3.0, 2.0, 5.0)
FEATURES = tuple(f"x{i}" for i in range(7))


def lookup(col: Column, table: dict) -> Column:
    """CASE over a small table; null for anything else."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def behaviour_code(name: Column) -> Column:
    return lookup(name, CODES).cast("int")


def tie_order(name: Column) -> Column:
    return lookup(name, TIE_ORDER).cast("int")


def weight(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), code + 1)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up on the binary value, as any engine with IEEE doubles computes it."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def digits_only(text: Column) -> Column:
    """Unsigned integer of digits alone that fits a long, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def finite_decimal(text: Column) -> Column:
    """Finite decimal without padding, else null."""
    # Fixed value: the grammar of a decimal.
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite(x: Column, what: str) -> Column:
    """``x``, failing when read if it is infinite or not a number; null stays."""
    return F.when(x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf"))), x).otherwise(F.raise_error(F.lit(f"{what} is not finite")).cast("double"))


def dot(bias: float, weights: tuple[float, ...], xs: list[Column]) -> Column:
    """bias + w0*x0 + ..., added in this order."""
    z = F.lit(float(bias))
    for w, x in zip(weights, xs, strict=True):
        z = z + F.lit(float(w)) * x
    return z


def logistic(z: Column) -> Column:
    """1/(1+e^-z) without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    p = clamp(p, eps, 1 - eps)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def l2(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def cadence(pressure: Column, low: int, high: int) -> Column:
    """Publication cadence of a pressure: linear from low to high, cut to a whole number."""
    p = clamp(pressure, 0.0, 1.0)
    return clamp(F.lit(low) + F.floor(p * F.lit(float(high - low))), low, high).cast("int")


def alpha_of(pressure: Column) -> Column:
    return F.lit(0.02) + F.lit(0.28) * clamp(pressure, 0.0, 1.0)


def first_hash_word(id_col: Column) -> Column:
    """The first four bytes of SHA-256 of the id's decimal text, as an unsigned number."""
    return F.conv(F.substring(F.sha2(id_col.cast("string"), 256), 1, 8), 16, 10).cast("long")


def without_folders(text: Column) -> Column:
    """Absolute paths cut to their last name: no folder of a machine or of a person is left."""
    return F.regexp_replace(text, r"(?:/[^/\s]+)+/([^/\s]+)", "$1")


def _redacted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return without_folders(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redacted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _redacted(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_redacted(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


def redacted(df: DataFrame) -> DataFrame:
    """``df`` with ``without_folders`` applied to every string in it, however deep it lies in structs, arrays and values of maps. Names of
    fields and keys of maps stay; so do nulls, and everything that is no text."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def ema_response(alpha: Column, omega: Column) -> dict[str, Column]:
    """Complex response of an exponential average with step ``alpha`` at ``omega``, and its group delay:
    alpha / (alpha + 2 p sin^2(omega/2) + i p sin(omega)), p = 1 - alpha."""
    p = 1 - alpha
    re, im = alpha + 2 * p * F.sin(omega / 2) * F.sin(omega / 2), p * F.sin(omega)
    norm = re * re + im * im
    # d/domega of the phase -atan2(im, re), with re' = p sin(omega) and im' = p cos(omega)
    delay = (re * p * F.cos(omega) - im * p * F.sin(omega)) / norm
    return {"real": alpha * re / norm, "imag": -alpha * im / norm, "group_delay": delay}


def variance_equivalent_span(alpha: Column) -> Column:
    return (2 - alpha) / alpha
