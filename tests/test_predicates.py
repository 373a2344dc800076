import pytest
from pyspark.sql import functions as F

from tidewatch.operators.fields import EventFields, canonical_metadata, key_variants, merge_maps
from tidewatch.operators.predicates import PREDICATES, predicate


def check(spark, operator, value, rows, expected, **options):
    """Truth of a predicate over single text values, null included."""
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, f string")
    field = EventFields(frame.schema).resolve("f")
    found = frame.select("i", predicate(field, operator, value, **options).alias("hit")).orderBy("i").collect()
    assert [row.hit for row in found] == expected, operator


TABLE = [
    ("equals", "b", ["b", "B", "a", None], [True, False, False, False]),
    ("equals", None, ["b", None], [False, True]),
    ("equals", "1,000", ["1000", " 1000.0 ", "1e3", "x", None], [True, True, True, False, False]),
    ("not_equals", "b", ["b", "a", None], [False, True, True]),
    ("contains", "b", ["abc", "ABC", "", None], [True, False, False, False]),
    ("not_contains", "b", ["abc", "x", None], [False, True, True]),
    ("starts_with", "ab", ["abc", "xab", None], [True, False, False]),
    ("ends_with", "bc", ["abc", "bca", None], [True, False, False]),
    ("greater_than", 5, ["6", "5", "x", "", None], [True, False, False, False, False]),
    ("greater_than_or_equal", "5", ["5", "4", None], [True, False, False]),
    ("less_than", 5, ["4", "5", "NaN", None], [True, False, False, False]),
    ("less_than_or_equal", 5, ["5", "1d", None], [True, False, False]),
    ("greater_than", "high", ["6", "zzz"], [False, False]),
    ("in", ["a", 7], ["a", "7.0", "A", "8", None], [True, True, False, False, False]),
    ("not_in", ["a"], ["a", "b", None], [False, True, True]),
    ("regex", "B.D", ["xbadx", "xb-dx", "bd", None], [True, True, False, False]),
    ("regex", "(", ["(", None], [False, False]),
    ("exists", None, ["", "a", None], [True, True, False]),
    ("not_exists", None, ["", None], [False, True]),
]


@pytest.mark.parametrize("operator,value,rows,expected", TABLE)
def test_truth_table(spark, operator, value, rows, expected):
    check(spark, operator, value, rows, expected)
    check(spark, operator, value, rows, [not hit for hit in expected], negate=True)


def test_every_operator_is_in_the_table():
    assert {row[0] for row in TABLE} == set(PREDICATES)


def test_case_flag(spark):
    check(spark, "equals", "b", ["B"], [True], case_sensitive=False)
    check(spark, "in", ["B"], ["b"], [True], case_sensitive=False)
    check(spark, "contains", "B", ["abc"], [True], case_sensitive=False)


def test_numeric_column(spark):
    frame = spark.createDataFrame([(1, 22), (2, None)], "i int, destination_port int")
    field = EventFields(frame.schema).resolve("destinationPort")
    row = frame.select(
        predicate(field, "equals", "22").alias("a"), predicate(field, "in", [22.0, "x"]).alias("b"),
        predicate(field, "not_equals", 22).alias("c"), predicate(field, "contains", "2").alias("d")).collect()
    assert [tuple(r) for r in row] == [(True, True, False, True), (False, False, True, False)]


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "cast(id as string) as severity").write.parquet(path)
    frame = spark.read.parquet(path)
    field = EventFields(frame.schema).resolve("severity")
    plan = frame.filter(predicate(field, "equals", "high"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(severity,high)" in plan


def test_metadata_keys(spark):
    assert key_variants("file-path")[:2] == ["file-path", "file_path"]
    frame = spark.createDataFrame([({"File-Path": "a", "queryName": "q", "USER name": "u"},)],
                                  "metadata map<string,string>")
    fields = EventFields(frame.schema)
    row = frame.select(fields.resolve("file_path").column.alias("a"), fields.resolve("query_name").column.alias("b"),
                       fields.resolve("metadata.user_name").column.alias("c"),
                       fields.resolve("enrichment.x").column.alias("d")).first()
    assert tuple(row) == ("a", "q", "u", None)
    strict = EventFields(frame.schema, loose_keys=False)
    assert frame.select(strict.resolve("file_path").column.alias("a")).first().a is None
    canonical = frame.withColumn("metadata", canonical_metadata(F.col("metadata")))
    assert canonical.select(strict.resolve("file_path").column.alias("a")).first().a == "a"


def test_merge_maps(spark):
    frame = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert frame.select(merge_maps(F.col("x"), F.col("y")).alias("m")).first().m == {"a": "1", "b": "3"}
