"""A dictionary that grows: keys stay, versions stay, and the table's side of a join is not shuffled."""

import random

import pytest

from buildlens.operators.vocabulary import Vocabulary


def values(spark, of, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"{of}{rng.randrange(n)}" if rng.random() < 0.9 else None,) for _ in range(300)], "v string")


@pytest.fixture
def words(spark):
    spark.sql("drop table if exists words")
    yield Vocabulary(spark, "words", buckets=4)
    spark.sql("drop table if exists words")


def keys(vocabulary):
    return {r["value"]: r["key"] for r in vocabulary.rows().collect()}


def test_growing_keeps_keys(spark, words):
    first, second = values(spark, "a", 60, 1), values(spark, "a", 90, 2).union(values(spark, "b", 30, 3))
    one = words.grow(first, "v")
    old = keys(one)
    two = words.grow(second, "v")
    new = keys(two)
    assert old.items() <= new.items() and sorted(new.values()) == list(range(len(new)))
    whole = {r["v"] for r in first.union(second).where("v is not null").distinct().collect()}
    assert set(new) == whole and keys(one) == old and (one.version, two.version, words.latest()) == (1, 2, 2)
    assert words.grow(second, "v").version == 2 and keys(words) == new
    assert sorted(old, key=old.get) == sorted(old)
    with pytest.raises(ValueError, match="frozen"):
        one.grow(second, "v")


def test_round_trip_and_plan(spark, words):
    rows = values(spark, "w", 50, 7).withColumnRenamed("v", "word")
    assert words.rows().count() == 0 and words.encode(rows, "word", "k").where("k is not null").count() == 0
    words.grow(rows, "word")
    back = words.decode(words.encode(rows, "word", "k"), "k", "word")
    assert sorted(map(str, (r["word"] for r in back.collect()))) == sorted(map(str, (r["word"] for r in rows.collect())))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows.write.bucketBy(4, "word").mode("overwrite").saveAsTable("facts")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert plan(words.encode(spark.table("facts"), "word", "k")).count("Exchange hashpartitioning") == 0
        assert plan(words.encode(rows, "word", "k")).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists facts")
