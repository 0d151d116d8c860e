"""Row digests: 128 bits that identify a row by its values.

Two rows have the same digest when they agree after these foldings:

* NULL, ``''`` and NaN are the same value;
* ``-0.0`` is ``0.0``;
* numbers compare by value (``1``, ``1.0``, decimal ``1.00``), and where one side is a whole
  number or decimal of more than 15 digits and the other floating point, digit by digit;
* dates and timestamps compare as points in time, without zone.

Both sides are first cast to one type per column, so the digest does not depend
on how each side happens to store a value. The digest is two seeded 64-bit
hashes of the typed values, so it never renders a number as text, stays in
generated code, and moves 16 bytes per row through a shuffle. The hash function
skips NULLs, so whether each value is NULL is hashed as well. Arrays, maps and structs
compare as the JSON text of their values, folded at every depth as above, numbers by value
too and maps whatever the order of their entries. A struct or array of NULLs is not NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinkeep.functions.names import identifier

H1, H2 = "_h1", "_h2"
DIGEST = [H1, H2]

_INTEGRAL_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


@dataclass(frozen=True)
class SharedColumn:
    """A column both sides have, and the type both are compared in."""

    name: str
    type: T.DataType


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (*_INTEGRAL_DIGITS, *_FRACTIONAL, T.DecimalType, T.BooleanType))


def _decimal_shape(kind: T.DataType) -> tuple[int, int]:
    """Digits before and after the point."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return _INTEGRAL_DIGITS.get(type(kind), 1), 0


#: Decimal digits that every double keeps.
_EXACT_DIGITS = 15


def _digits(kind: T.DataType) -> int:
    return 0 if isinstance(kind, _FRACTIONAL) else sum(_decimal_shape(kind))


def comparison_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which values of two column types are compared."""
    if isinstance(left, _NESTED) or isinstance(right, _NESTED):
        return left if left == right else T.StringType()
    if isinstance(left, _TIMES) and isinstance(right, _TIMES):
        return left if left == right else T.TimestampNTZType()
    if isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return T.StringType()
    if _is_number(left) and _is_number(right):
        if left == right and not isinstance(left, _FRACTIONAL):
            return left
        if isinstance(left, _FRACTIONAL) and isinstance(right, _FRACTIONAL):
            return T.DoubleType()
        if isinstance(left, _FRACTIONAL) or isinstance(right, _FRACTIONAL):
            return T.StringType() if max(map(_digits, (left, right))) > _EXACT_DIGITS else T.DoubleType()
        if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
            whole = max(_decimal_shape(left)[0], _decimal_shape(right)[0])
            scale = max(_decimal_shape(left)[1], _decimal_shape(right)[1])
            return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
        return T.LongType()
    return left if left == right else T.StringType()


def shared_columns(
    source: DataFrame, destination: DataFrame, columns: Sequence[str] | None = None
) -> list[SharedColumn]:
    """Columns of both sides by name, in source order."""
    right = {f.name: f.dataType for f in destination.schema}
    wanted = source.columns if columns is None else list(columns)
    left = {f.name: f.dataType for f in source.schema}
    return [
        SharedColumn(name, comparison_type(left[name], right[name]))
        for name in wanted
        if name in left and name in right
    ]


def own_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[SharedColumn]:
    """The columns of one table, for digests that are compared within it."""
    return shared_columns(df, df, columns)


# Expressions are composed as SQL text: a table of a thousand columns then costs
# one call into the engine per digest instead of several per column.

_WITH_NULLS = "map('ignoreNullFields', 'false')"


def _inside(value: str, kind: T.DataType, depth: int = 0) -> str:
    """SQL text of a nested value with every value in it folded: NULL where it folds to
    nothing, numbers as text, maps as sorted entries."""
    part = f"e{depth}"
    if isinstance(kind, T.StringType):
        return f"nullif({value}, '')"
    if isinstance(kind, _FRACTIONAL):
        plain = f"CAST({value} AS DOUBLE)"
        return f"CASE WHEN NOT isnan({value}) THEN {_as_text(f'({plain} + 0.0D)', T.DoubleType())} END"
    if isinstance(kind, (*_INTEGRAL_DIGITS, T.DecimalType)):
        return _as_text(value, kind)
    if isinstance(kind, T.ArrayType):
        return f"transform({value}, {part} -> {_inside(part, kind.elementType, depth + 1)})"
    if isinstance(kind, T.MapType):
        both = [f"'{n}', {_inside(f'{part}.{n}', t, depth + 1)}" for n, t in (("key", kind.keyType), ("value", kind.valueType))]
        return f"array_sort(transform(map_entries({value}), {part} -> named_struct({', '.join(both)})))"
    if isinstance(kind, T.StructType):
        # Fields that only their place tells apart cannot be named.
        if not kind.fields or len({f.name.lower() for f in kind.fields}) < len(kind.fields):
            return f"to_json({value}, {_WITH_NULLS})"
        fields = [f"{_quoted(f.name)}, {_inside(f'{value}.{identifier(f.name)}', f.dataType, depth)}" for f in kind.fields]
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({', '.join(fields)}) END"
    if isinstance(kind, T.VariantType):
        return f"to_json({value}, {_WITH_NULLS})"
    if isinstance(kind, (T.BinaryType, T.BooleanType, *_TIMES)):
        return value
    return f"CAST({value} AS STRING)"


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _as_text(column: str, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, _NESTED):
        inside = column if isinstance(kind, T.VariantType) else _inside(column, kind)
        return f"to_json({inside}, {_WITH_NULLS})"
    text = f"CAST({column} AS STRING)"
    if isinstance(kind, _FRACTIONAL):
        # A whole number as a whole number's text; any other value can only equal a double.
        whole = f"{column} = floor({column}) AND abs({column}) < 1e37D"
        return f"CASE WHEN {whole} THEN CAST(CAST({column} AS DECIMAL(38, 0)) AS STRING) ELSE {_short(column)} END"
    if isinstance(kind, T.DecimalType) and kind.scale > 0:
        return rf"regexp_replace({text}, r'\.?0+$', '')"
    return text


def _short(column: str) -> str:
    """A fraction as a decimal of the digits a double keeps, or as its own text."""
    exact = f"TRY_CAST({column} AS DECIMAL(38, 18))"
    plain = rf"regexp_replace(CAST({exact} AS STRING), r'\.?0+$', '')"
    return f"CASE WHEN CAST({exact} AS DOUBLE) = {column} THEN {plain} ELSE CAST({column} AS STRING) END"


def normalised(df: DataFrame, shared: SharedColumn) -> str:
    """SQL text of the value that is hashed for one column of ``df``."""
    column = identifier(shared.name)
    own = df.schema[shared.name].dataType
    if isinstance(own, _FRACTIONAL):
        column = f"CASE WHEN NOT isnan({column}) THEN {column} + 0.0F END"
    if isinstance(shared.type, (T.StringType, *_NESTED)):
        return f"coalesce({_as_text(column, own)}, '')"
    return column if own == shared.type else f"CAST({column} AS {shared.type.simpleString()})"


def digest(df: DataFrame, shared: Sequence[SharedColumn]) -> list[str]:
    """SQL text of the two halves of the digest."""
    values = {c: normalised(df, c) for c in shared}
    flags = [
        f"isnull({value})"
        for c, value in values.items()
        if not isinstance(c.type, (T.StringType, *_NESTED))
    ]
    parts = ", ".join([*flags, *values.values()])
    return [f"xxhash64({seed}L, {parts}) AS {half}" for seed, half in enumerate(DIGEST, start=1)]


def with_digest(df: DataFrame, shared: Sequence[SharedColumn]) -> DataFrame:
    return df.selectExpr("*", *digest(df, shared))


def only_digest(df: DataFrame, shared: Sequence[SharedColumn], *more: str) -> DataFrame:
    """The digest of every row, and further columns given as SQL text."""
    return df.selectExpr(*digest(df, shared), *more)
