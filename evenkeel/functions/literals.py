"""SQL literals of SQL Server and PostgreSQL, chosen from the Spark type of a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def float_text(value: Column) -> Column:
    """Shortest round-trip text: plain from 0.0001 to below 1E+15, else with a signed
    exponent of at least two digits. NaN and infinities give null: the dialects say what becomes of them."""
    text = value.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(text, "^-", "")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(body, "E", 1), r"\.0$", ""), r"\.", "")
    power = F.substring_index(body, "E", -1).try_cast("int")
    whole = F.when(
        F.length(digits) <= power + 1, F.rpad(digits, power + 1, "0")
    ).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    rest = F.substring(digits, F.lit(2), F.length(digits))
    exponent = F.concat(
        F.substring(digits, 1, 1),
        F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""),
        F.when(power < 0, "E-").otherwise("E+"),
        F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(
            F.abs(power).cast("string")
        ),
    )
    scaled = F.when((power >= 0) & (power < 15), whole).when((power < 0) & (power >= -4), small).otherwise(exponent)
    plain = F.regexp_replace(body, r"\.0$", "")
    shown = F.when(F.instr(body, "E") > 0, scaled).otherwise(plain)
    return F.when(~not_finite(value), F.concat(sign, shown))


def _text(value: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def _utc(value: Column) -> Column:
    """Wall clock of an instant in UTC, whatever the session time zone is."""
    seconds = F.unix_micros(value).cast("decimal(24,6)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def not_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def _day_time(value: Column) -> Column:
    """A `time` value with six digits of its second."""
    text = value.cast("string")
    return F.concat(F.substring(text, 1, 8), F.lit("."), F.rpad(F.substring(text, 10, 6), 6, "0"))


def _time_of_day(value: Column) -> Column:
    return F.date_format(F.expr(_EPOCH) + F.abs(value), "HH:mm:ss.SSSSSS")


def mssql_literal(value: Column, dtype: T.DataType) -> Column:
    """Literal of one value for SQL Server; NULL becomes the word NULL."""
    if isinstance(dtype, T.BooleanType):
        out = F.when(value, "1").when(~value, "0")
    elif isinstance(dtype, _INTEGRAL):
        out = value.cast("string")
    elif isinstance(dtype, T.DecimalType):
        out = value.cast("string")  # plain digits in ANSI mode, the default
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        out = float_text(value)
    elif isinstance(dtype, T.TimestampNTZType):
        stamp = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        # The search cannot start in the seconds: a dot follows them.
        out = _quoted(F.regexp_replace(stamp, r"\.?0+$", ""))
    elif isinstance(dtype, T.TimestampType):
        out = _quoted(F.concat(F.date_format(_utc(value), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0 +00:00")))
    elif isinstance(dtype, T.DateType):
        out = _quoted(F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(dtype, T.DayTimeIntervalType):
        out = _quoted(F.concat(_time_of_day(value), F.lit("0")))
    elif isinstance(dtype, T.TimeType):
        out = _quoted(F.concat(_day_time(value), F.lit("0")))
    elif isinstance(dtype, T.BinaryType):
        out = F.concat(F.lit("0x"), F.hex(value))
    else:
        out = _text(value.cast("string"), "N")
    return F.coalesce(out, F.lit("NULL"))


def pg_literal(value: Column, dtype: T.DataType) -> Column:
    """Literal of one value for PostgreSQL; NULL becomes the word NULL."""
    if isinstance(dtype, T.BooleanType):
        out = F.when(value, "TRUE").when(~value, "FALSE")
    elif isinstance(dtype, _INTEGRAL):
        out = value.cast("string")
    elif isinstance(dtype, T.DecimalType):
        out = value.cast("string")  # plain digits in ANSI mode, the default
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        words = F.when(F.isnan(value), "'NaN'").when(value > 0, "'Infinity'").otherwise("'-Infinity'")
        out = F.when(not_finite(value), words).otherwise(float_text(value))
    elif isinstance(dtype, T.TimestampNTZType):
        out = _quoted(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif isinstance(dtype, T.TimestampType):
        out = _quoted(F.concat(F.date_format(_utc(value), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00")))
    elif isinstance(dtype, T.DateType):
        out = _quoted(F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(dtype, T.DayTimeIntervalType):
        out = _quoted(_time_of_day(value))
    elif isinstance(dtype, T.TimeType):
        out = _quoted(_day_time(value))
    elif isinstance(dtype, T.BinaryType):
        out = F.concat(F.lit("'\\x"), F.hex(value), F.lit("'"))
    else:
        out = _text(value.cast("string"), "")
    return F.coalesce(out, F.lit("NULL"))
