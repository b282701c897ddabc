"""Versioned tables: readers never miss one, failed and competing writes lose nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources import upsert as u
from tidemark.sources.versioned import VersionedTable, WriteConflict


@pytest.fixture
def name(spark):
    table = f"results_{uuid.uuid4().hex[:8]}"
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def frame(spark, rows, schema="k int, v string"):
    return spark.createDataFrame(rows, schema)


def test_versions_and_conflicts(spark):
    store = VersionedTable(spark, scratch_path(spark, "versions"))
    assert store.version() == 0
    with pytest.raises(LookupError):
        store.read()
    assert store.write(frame(spark, [(1, "a")]), 0) == 1
    staged = [store.stage(frame(spark, [(i, "x")])) for i in (2, 3)]
    assert store.read().collect() == [(1, "a")]  # staged rows are nobody's table yet
    assert store.commit(staged[0], 1) == 2
    with pytest.raises(WriteConflict):
        store.commit(staged[1], 1)
    assert store.read().collect() == [(2, "x")] and store.read(1).collect() == [(1, "a")]


def test_failed_write_leaves_the_old_table(spark, name):
    assert u.upsert_table(spark, name, frame(spark, [(1, "a"), (2, "b")]), ["k"]) == 2
    broken = frame(spark, [(2, "c")]).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        u.upsert_table(spark, name, broken, ["k"])
    assert sorted(map(tuple, spark.read.table(name).collect())) == [(1, "a"), (2, "b")]
    assert u.versions_of(spark, name).version() == 1


def test_readers_never_miss_the_table(spark, name, monkeypatch):
    u.upsert_table(spark, name, frame(spark, [(1, "a")]), ["k"])
    seen = []
    real = VersionedTable.commit

    def looks(self, staged, base):
        seen.append(sorted(map(tuple, spark.read.table(name).collect())))
        out = real(self, staged, base)
        seen.append(sorted(map(tuple, spark.read.table(name).collect())))
        return out

    monkeypatch.setattr(VersionedTable, "commit", looks)
    u.upsert_table(spark, name, frame(spark, [(2, "b")]), ["k"])
    assert seen == [[(1, "a")], [(1, "a")]] and spark.read.table(name).count() == 2


def test_two_writers_keep_both_rows(spark, name, monkeypatch):
    u.upsert_table(spark, name, frame(spark, [(1, "a")]), ["k"])
    real, raced = VersionedTable.stage, []

    def races(self, df):
        if not raced:  # another writer commits between this one's read and its commit
            raced.append(1)
            u.upsert_table(spark, name, frame(spark, [(2, "other")]), ["k"])
        return real(self, df)

    monkeypatch.setattr(VersionedTable, "stage", races)
    assert u.upsert_table(spark, name, frame(spark, [(3, "mine")]), ["k"]) == 1
    assert sorted(map(tuple, spark.read.table(name).collect())) == [(1, "a"), (2, "other"), (3, "mine")]
    assert u.versions_of(spark, name).version() == 3


def test_counts_inserted_and_changed(spark, name):
    schema = "k int, v string, w double"
    u.upsert_table(spark, name, frame(spark, [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], schema), ["k"])
    again = frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, None, None), (4, "d", None), (4, "d", None), (None, "n", None)], schema)
    assert u.upsert_table(spark, name, again, ["k"]) == 3  # 2 changed, 4 and the null key inserted
    assert u.upsert_table(spark, name, again, ["k"]) == 0
    wider = frame(spark, [(1, "x")], "k int, extra string")
    assert u.upsert_table(spark, name, wider, ["k"]) == 1
    row = spark.read.table(name).where("k = 1").first()
    assert (row.v, row.w, row.extra) == ("a", 1.0, "x")
    marks = u.upsert(frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(2, "z"), (3, "c")]), ["k"], mark="m")
    assert {r.k: r.m for r in marks.collect()} == {1: "kept", 2: "changed", 3: "inserted"}
