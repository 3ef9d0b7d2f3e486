"""Orphan references: match semantics, times, hot keys, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators.references import name_key, orphan_references
from lodeweave.operators.skew import hot_keys, salted_join

R = "id int, a string, b string, t int"
ROWS = [(1, "x", "y", 5), (2, "x", None, 5), (3, None, "q", 5), (4, None, None, 5), (5, "x", "z", 5), (6, "x", "y", 1), (6, "x", "y", 1)]
TARGETS = [("x", "y", 3, 0), ("x", "y", 9, 0), ("w", "q", 4, 0)]


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, R), spark.createDataFrame(TARGETS, "a string, b string, since int, id int")


def test_match_semantics(tables):
    refs, targets = tables
    assert ids(orphan_references(refs, targets, ["a", "b"], "simple")) == [5]
    assert ids(orphan_references(refs, targets, ["a", "b"], "full")) == [2, 3, 5]
    assert ids(orphan_references(refs, targets, ["a", "b"], "partial")) == [5]
    with pytest.raises(ValueError):
        orphan_references(refs, targets, ["a"], "some")


def test_late_targets(tables):
    refs, targets = tables
    assert ids(orphan_references(refs, targets, ["a", "b"], "simple", "t", "since")) == [5, 6, 6]
    late = refs.withColumn("t", F.lit(None).cast("int"))
    assert ids(orphan_references(late, targets, ["a", "b"], "simple", "t", "since")) == [1, 5, 6, 6]


def test_empty(tables):
    refs, targets = tables
    assert ids(orphan_references(refs.limit(0), targets, ["a", "b"])) == []
    assert ids(orphan_references(refs, targets.limit(0), ["a", "b"])) == [1, 5, 6, 6]


def test_clashing_columns(tables):
    refs, targets = tables
    out = orphan_references(refs.withColumn("since", F.lit("kept")), targets, ["a", "b"], "simple", "t", "since")
    assert out.columns == ["id", "a", "b", "t", "since"] and {r.since for r in out.collect()} == {"kept"}


def test_hot_key_is_spread(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert [r.k for r in hot_keys(left, ["k"]).collect()] == ["hot"]
    right = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    out = salted_join(left, right, ["k"], "inner", F.col("id"))
    assert out.count() == 1001 and out.columns == ["id", "k", "v"]
    assert salted_join(left, right, ["k"], "left_anti", F.col("id")).count() == 1999


def test_name_key(spark):
    df = spark.createDataFrame([("  A_b-C \t d ",), (None,)], "n string").select(name_key(F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == ["a b c d", None]
