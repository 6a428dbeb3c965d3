"""What the document operators share: joins on hot keys, names, and what workers remember."""

import pytest
from pyspark.sql import functions as F

from tillcast.llm import common
from tillcast.session import materialize


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_rows_meet_their_key_whether_it_is_hot_or_not(spark, pieces, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = [(i, "a" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 40}") for i in range(600)]
    left = materialize(spark.createDataFrame(rows, "n int, key string"))
    side = materialize(spark.createDataFrame([("a", 1), *[(f"k{i}", i) for i in range(0, 40, 2)], ("unused", 7)], "key string, v int"))
    values = {r.key: r.v for r in side.collect()}
    out = common.attach_by_key(left, side, "key")
    assert sorted(map(tuple, out.select("n", "key", "v").collect())) == sorted((n, k, values.get(k)) for n, k in rows)
    assert common.attach_by_key(left.limit(0), side, "key").count() == 0
    assert common.attach_by_key(left, side.limit(0), "key").where("v is not null").isEmpty()


def test_only_hot_keys_are_broadcast(spark, monkeypatch):
    """Of 400 keys one has most rows: the broadcast side holds that one."""
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    left = materialize(spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 400).alias("key")))
    stored = []
    monkeypatch.setattr(common, "materialize", lambda df: stored.append(df) or materialize(df))
    side = materialize(spark.range(-1, 400).select(F.col("id").alias("key"), F.lit(1).alias("v")))
    assert common.attach_by_key(left, side, "key").where("v = 1").count() == 4000
    assert [r.key for r in stored[0].collect()] == [-1]


def test_memory_keeps_what_is_used_and_a_bounded_number():
    memory = common.Memory(10)
    for i in range(1000):
        if memory.get("often") is None:
            memory.put("often", 1)
        memory.put(i, i)
        assert len(memory.new) <= 10 and len(memory.old) <= 10 and memory.get("often") == 1
    assert memory.get(999) == 999 and memory.get(5) is None


def test_free_names_clash_with_no_column(spark):
    df = spark.range(3).select("id", F.lit(1).alias("_GONE"), F.lit(1).alias("_gone_"))
    name = common.free_name(df, "_gone")
    assert name.lower() not in {c.lower() for c in df.columns}
    gone = materialize(spark.createDataFrame([(1,)], "_gone long"))
    assert sorted(r.id for r in common.without(df, F.col("id"), gone).collect()) == [0, 2]
    assert common.without(df, F.col("id"), gone).columns == df.columns


def test_lean_tasks_give_their_batches_on():
    assert list(common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // b for b in batches))(iter([0])))
