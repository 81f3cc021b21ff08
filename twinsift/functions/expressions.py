"""Column expressions: canonical types, content equality across types, hashes, Wilson intervals, key text, hit tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard normal quantile of a 95 % interval.
Z = 1.959963984540054

# Document types of column types.
TYPE_NAMES = {"boolean": "BOOLEAN", "tinyint": "INT32", "smallint": "INT32", "int": "INT32", "bigint": "INT64", "float": "DOUBLE", "double": "DOUBLE", "string": "STRING", "date": "DATE_TIME", "timestamp": "DATE_TIME", "timestamp_ntz": "DATE_TIME", "binary": "BINARY", "void": "NULL"}
# Most digits of integral types.
WHOLE_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return "DECIMAL128"
    if isinstance(t, (T.StructType, T.MapType)):
        return "DOCUMENT"
    if isinstance(t, T.ArrayType):
        return "ARRAY"
    return TYPE_NAMES.get(t.simpleString(), "STRING")


def number_text(c: Column, t: T.DataType) -> Column:
    """A number as one text for each value, whatever its type: sign, digits without zeros at either end, exponent of ten.

    A double stands for its shortest decimal text, a float for the double it is; NaN and the infinities for themselves.
    """
    text = (c.cast("double") if isinstance(t, T.FloatType) else c).cast("string")
    mantissa, exponent = F.regexp_extract(text, "^-?([0-9.]+)", 1), F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1)
    digits = F.regexp_replace(mantissa, "[.]", "")
    behind = F.when(F.instr(mantissa, ".") > 0, F.length(mantissa) - F.instr(mantissa, ".")).otherwise(F.lit(0))
    short = F.regexp_replace(digits, "0+$", "")
    power = F.coalesce(exponent.try_cast("int"), F.lit(0)) - behind + F.length(digits) - F.length(short)
    sign = F.when(text.startswith("-"), "-").otherwise("")
    exact = F.when(short == "", "0").otherwise(F.concat(sign, F.regexp_replace(short, "^0+", ""), F.lit("e"), power.cast("string")))
    return F.when(text.rlike("^[+-]?(NaN|Infinity)$"), text).otherwise(exact)


def _room(t: T.DataType) -> tuple[int, int]:
    """Digits before and behind the point that hold any value of a decimal or integral type."""
    return (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (WHOLE_DIGITS[t.simpleString()], 0)


def _same_number(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Equality of numbers of different types; as numbers wherever that is exact, else by number_text()."""
    if "DOUBLE" not in (type_name(ta), type_name(tb)):
        whole, scale = map(max, _room(ta), _room(tb))
        if whole + scale <= 38:
            wide = T.DecimalType(whole + scale, scale)
            return a.cast(wide).eqNullSafe(b.cast(wide))
    text = number_text(a, ta).eqNullSafe(number_text(b, tb))
    i, d = (a, b) if type_name(tb) == "DOUBLE" else (b, a)
    kind = type_name(ta if type_name(tb) == "DOUBLE" else tb)
    native = i.cast("double").eqNullSafe(d.cast("double"))
    if kind == "INT32":
        return native
    if kind == "INT64":  # a double below 2^53 is a whole number's only if it is that number; above, its shortest text decides
        return F.when(F.abs(d) < float(1 << 53), native).otherwise(text)
    return text


def same(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Whether two leaves have equal content; numbers of different types are equal if their values are; null equals null."""
    na, nb = type_name(ta), type_name(tb)
    if ta == tb or {na, nb} <= {"INT32", "INT64"} or na == nb == "DATE_TIME":
        return a.eqNullSafe(b)
    if na == nb == "DOUBLE":
        return a.cast("double").eqNullSafe(b.cast("double"))
    if {na, nb} <= {"INT32", "INT64", "DOUBLE", "DECIMAL128"}:
        return _same_number(a, ta, b, tb)
    if na == nb:
        return a.cast("string").eqNullSafe(b.cast("string"))
    return a.isNull() & b.isNull()


def rendered(c: Column, t: T.DataType) -> Column:
    """A leaf as the examples show it, at most 120 characters."""
    name = type_name(t)
    if name == "STRING":
        text = F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    elif name == "DATE_TIME":
        text = F.concat(F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    elif name in ("DOUBLE", "DECIMAL128"):
        number = c.cast("string")
        text = F.when(number.rlike("[.]0+$"), F.regexp_replace(number, "[.]0+$", "")).otherwise(number)
    elif name == "BINARY":
        text = F.concat(F.lit("Binary(0, "), F.base64(c), F.lit(")"))
    else:
        text = c.cast("string")
    text = F.coalesce(text, F.lit("null"))
    return F.when(F.length(text) <= 120, text).otherwise(F.concat(F.substring(text, 1, 119), F.lit("…")))


def wilson(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """(point, lower, upper) of k successes in n trials, null for n = 0; the interval always holds the point and stays within 0 and 1."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, z2 = k / n, Z * Z
    d, c = 1 + z2 / n, p + z2 / (2 * n)
    h = F.lit(Z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return p, F.greatest(F.lit(0.0), F.least(p, (c - h) / d)), F.least(F.lit(1.0), F.greatest(p, (c + h) / d))


def hit(key: Column, spec: str, fraction: float) -> Column:
    """Whether a change hits a key: a fixed share of the keys, the same in every run and in any SQL engine with md5."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("#" + spec))), 1, 8), 16, 10).cast("bigint")
    return h < int(fraction * 4294967296)


def sample_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit("#" + seed)))
