"""Which values count as the same value."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from twinkeep.functions.digest import comparison_type, only_digest, own_columns, shared_columns


def digests(df, other=None):
    shared = shared_columns(df, other) if other is not None else own_columns(df)
    return [tuple(r) for r in only_digest(df, shared).collect()]


def same(spark, left_type, left, right_type, right) -> bool:
    a = spark.createDataFrame([(left,)], f"c {left_type}")
    b = spark.createDataFrame([(right,)], f"c {right_type}")
    shared = shared_columns(a, b)
    return only_digest(a, shared).collect() == only_digest(b, shared).collect()


@pytest.mark.parametrize(
    "left_type, left, right_type, right",
    [
        ("string", None, "string", ""),
        ("double", None, "double", math.nan),
        ("double", -0.0, "double", 0.0),
        ("int", 1, "double", 1.0),
        ("int", 1, "bigint", 1),
        ("float", 0.5, "double", 0.5),
        ("boolean", True, "int", 1),
        ("decimal(10,2)", Decimal("1.10"), "decimal(10,1)", Decimal("1.1")),
        ("decimal(10,2)", Decimal("1.00"), "int", 1),
        ("decimal(38,30)", Decimal("1.5"), "decimal(38,2)", Decimal("1.50")),
        ("int", 7, "string", "7"),
        ("bigint", None, "string", ""),
        ("map<string,int>", {"a": 1, "b": 2}, "map<string,int>", {"b": 2, "a": 1}),
        ("array<double>", [0.0, None], "array<double>", [-0.0, math.nan]),
        ("array<float>", [0.5], "array<double>", [0.5]),
        ("array<int>", [1], "array<decimal(10,2)>", [Decimal("1.00")]),
        ("array<bigint>", [7], "array<double>", [7.0]),
        ("array<string>", ["", "a"], "array<string>", [None, "a"]),
        ("struct<a:string,b:double>", ("", math.nan), "struct<a:string,b:double>", (None, None)),
        ("map<string,double>", {"a": -0.0, "b": math.nan}, "map<string,double>", {"b": None, "a": 0.0}),
        ("array<map<string,struct<`x y`:string>>>", [{"a": ("",)}], "array<map<string,struct<`x y`:string>>>", [{"a": (None,)}]),
        ("map<int,map<string,string>>", {1: {"a": "", "b": "c"}}, "map<int,map<string,string>>", {1: {"b": "c", "a": None}}),
        ("struct<`it's`:double>", (-0.0,), "struct<`it's`:double>", (0.0,)),
    ],
)
def test_same_value(spark, left_type, left, right_type, right):
    assert same(spark, left_type, left, right_type, right)


@pytest.mark.parametrize(
    "left_type, left, right_type, right",
    [
        ("string", "a", "string", "A"),
        ("string", "a", "string", "a "),
        ("bigint", None, "bigint", 0),
        ("double", math.nan, "double", 0.0),
        ("decimal(10,2)", Decimal("1.10"), "decimal(10,2)", Decimal("1.01")),
        ("binary", None, "binary", b""),
        ("array<int>", [1, None], "array<int>", [None, 1]),
        ("struct<a:int,b:int>", (1, None), "struct<a:int,b:int>", (None, 1)),
        ("map<string,int>", {"a": 1}, "map<string,int>", {"a": 2}),
        ("array<string>", [""], "array<string>", []),
        ("array<string>", [None], "array<string>", None),
        ("struct<a:string>", (None,), "struct<a:string>", None),
        ("array<double>", [0.1], "array<double>", [0.2]),
        ("map<string,double>", {"a": 0.0}, "map<string,double>", {"b": 0.0}),
        ("array<array<string>>", [["a"], ["b"]], "array<array<string>>", [["a", "b"]]),
    ],
)
def test_different_value(spark, left_type, left, right_type, right):
    assert not same(spark, left_type, left, right_type, right)


def test_fraction_of_a_second_counts(spark):
    times = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:00:00' AS t "
        "UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:00.000001'"
    )
    assert len(set(digests(times))) == 2


def test_date_equals_midnight(spark):
    a = spark.sql("SELECT date'2024-01-01' AS t")
    b = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t")
    assert digests(a, b) == digests(b, a)


def test_null_positions_count(spark):
    rows = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert len(set(digests(rows))) == 2


def test_cell_borders_count(spark):
    rows = spark.createDataFrame(
        [("a|", "b"), ("a", "|b"), ("a|b", ""), ("", "a|b"), ("'", '"\\')], "a string, b string"
    )
    assert len(set(digests(rows))) == 5


def test_columns_match_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 1, 9)], "b string, a int, c int")
    assert [c.name for c in shared_columns(a, b)] == ["a", "b"]
    assert digests(a, b) == [
        tuple(r) for r in only_digest(b, shared_columns(a, b)).collect()
    ]


def test_comparison_types():
    assert comparison_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert comparison_type(T.DecimalType(10, 2), T.DecimalType(12, 4)) == T.DecimalType(12, 4)
    assert comparison_type(T.DecimalType(38, 20), T.LongType()) == T.StringType()
    assert comparison_type(T.DateType(), T.TimestampType()) == T.TimestampNTZType()
    assert comparison_type(T.StringType(), T.LongType()) == T.StringType()


cell = st.one_of(st.none(), st.integers(-3, 3))
text = st.one_of(st.none(), st.sampled_from(["", "a", "b", "ab", "1", "é"]))
number = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0, math.nan, 1.5]))
table = st.lists(st.tuples(cell, text, number), min_size=1, max_size=12)


def folded(row):
    whole, word, real = row
    real = None if real is None or math.isnan(real) else real + 0.0
    return whole, word or "", real


@settings(max_examples=15, derandomize=True, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=table)
def test_digest_is_equality_of_folded_rows(spark, rows):
    found = digests(spark.createDataFrame(rows, "a bigint, b string, c double").coalesce(1))
    for i, left in enumerate(rows):
        for j, right in enumerate(rows):
            assert (found[i] == found[j]) == (folded(left) == folded(right))


nested = st.one_of(
    st.none(),
    st.lists(
        st.one_of(
            st.none(),
            st.tuples(text, number, st.one_of(st.none(), st.dictionaries(st.sampled_from(["", "a", "b"]), number, max_size=2))),
        ),
        max_size=3,
    ),
)


def deeply_folded(value):
    """As the digest should see it: nothing is one value, maps have no order."""
    if isinstance(value, list):
        return ["list", *[deeply_folded(v) for v in value]]
    if isinstance(value, tuple):
        return ["struct", *[deeply_folded(v) for v in value]]
    if isinstance(value, dict):
        return ["map", *sorted([k, repr(deeply_folded(v))] for k, v in value.items())]
    if value is None or value == "" or isinstance(value, float) and math.isnan(value):
        return None
    return value + 0.0 if isinstance(value, float) else value


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(nested, min_size=1, max_size=12))
def test_nested_values_fold_at_every_depth(spark, values):
    kind = "n int, c array<struct<a:string,b:double,m:map<string,double>>>"
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], kind)
    shared = [c for c in own_columns(frame) if c.name == "c"]
    found = {r.n: (r._h1, r._h2) for r in only_digest(frame, shared, "n").collect()}
    for i in range(len(values)):
        for k in range(i):
            assert (found[i] == found[k]) == (deeply_folded(values[i]) == deeply_folded(values[k]))
