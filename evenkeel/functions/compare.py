"""The forms in which values of the two sides are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FLOATS = (T.FloatType, T.DoubleType)


def _as_decimal(dtype: T.DataType) -> T.DecimalType | None:
    if isinstance(dtype, T.DecimalType):
        return dtype
    return T.DecimalType(20, 0) if dtype in _INTEGRAL else None


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type both sides are compared in; None if no type holds both exactly and they are
    compared as `exact_text`."""
    if a == b:
        return a
    ints = [t for t in (a, b) if t in _INTEGRAL]
    if len(ints) == 2:
        return max(ints, key=_INTEGRAL.index)
    if isinstance(a, _FLOATS) and isinstance(b, _FLOATS):
        return T.DoubleType()
    decimals = [_as_decimal(t) for t in (a, b)]
    if all(decimals):
        scale = max(d.scale for d in decimals)
        whole = max(d.precision - d.scale for d in decimals)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if any(decimals) and any(isinstance(t, _FLOATS) for t in (a, b)):
        return None
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        both_local = not any(isinstance(t, T.TimestampType) for t in (a, b))
        return T.TimestampNTZType() if both_local else T.TimestampType()
    if isinstance(a, (T.ArrayType, T.StructType, T.MapType)) and type(a) is type(b):
        return a
    return T.StringType()


def _plain(number: Column) -> Column:
    """Digits of a decimal without zeros at the end of its fraction."""
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def exact_text(value: Column, dtype: T.DataType) -> Column:
    """Digits of a number, equal for equal numbers of any numeric type. A double stands for
    the shortest digits that give it back; what no decimal holds keeps its own text."""
    if not isinstance(dtype, _FLOATS):
        return _plain(value)
    text, size = value.cast("string"), F.abs(value.cast("double"))
    # Seventeen digits fit in each of these ranges.
    fits = F.when((size == 0) | ((size >= 0.1) & (size < 1e19)), _plain(text.try_cast("decimal(38,18)")))
    fits = fits.when((size >= 1e19) & (size < 1e37), _plain(text.try_cast("decimal(38,0)")))
    fits = fits.when((size < 0.1) & (size >= 1e-20), _plain(text.try_cast("decimal(38,38)")))
    return F.coalesce(F.when(fits == "-0", "0").otherwise(fits), text)


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(has_map(f.dataType) for f in dtype.fields)


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A form that `<=>`, grouping and sorting accept: maps become sorted entries, at any depth."""
    if not has_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                comparable(e["key"], dtype.keyType).alias("key"), comparable(e["value"], dtype.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, dtype.elementType))
    return F.when(
        value.isNotNull(), F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    )
