"""Encoding at full width: one pass and cut plans agree, shuffles do not grow, hot and odd cells."""

import re

from pyspark.sql import functions as F

from tidemark.operators import encode
from tidemark.plans import fixtures as fx


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_one_pass_equals_cut_joins_at_full_width(spark, sf_dir):
    df = fx.wide_impressions(spark, sf_dir).filter("l_orderkey % 7 = 0")
    maps = encode.build_index_maps(df.filter(F.col("split") == "train"), fx.WIDE_CATEGORIES)
    cuts = []

    def cut(part, i):
        cuts.append(i)
        return encode.materialize_to_table(part, i)

    chunked = encode.apply_index_maps(df, maps, fx.WIDE_CATEGORIES, chunk=6, materialize=cut)
    assert cuts == [0, 6, 12, 18, 24]
    wide = encode.apply_index_maps_wide(df, maps, fx.WIDE_CATEGORIES)
    assert wide.columns == chunked.columns == df.columns + [f"{c}_idx" for c in fx.WIDE_CATEGORIES]
    assert wide.exceptAll(chunked).count() == chunked.exceptAll(wide).count() == 0 and wide.count() == df.count()


def test_shuffles_do_not_grow_with_the_columns(spark):
    rows = spark.range(4000).select(
        "id", *[F.concat(F.lit("v"), (F.col("id") * (k + 1) % (5 + 40 * k)).cast("string")).alias(f"C{k}") for k in range(20)]
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = []
        for n in (2, 20):
            columns = [f"C{k}" for k in range(n)]
            maps = encode.build_index_maps(rows.filter("id % 3 > 0"), columns)
            plan = _plan(encode.apply_index_maps_wide(rows, maps, columns, row_id="id"))
            seen.append(len(re.findall(r"\bExchange hashpartitioning", plan)))
        # cells and the long map meet by value, indices and rows by row
        assert seen == [3, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_null_unseen_and_repeated_rows(spark):
    schema = "id long, a string, b string, _own string, _at int"
    train = spark.createDataFrame([(i, ["x", "y", None, "x"][i % 4], str(i % 3), "o", 1) for i in range(40)], schema)
    maps = encode.build_index_maps(train, ["a", "b"])
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "x", None if i % 5 else "0", "o", 1) for i in range(300)] * 2, schema)
    got = encode.apply_index_maps_wide(rows, maps, ["a", "b"])
    assert got.columns == [*rows.columns, "a_idx", "b_idx"] and got.count() == 600
    for r in got.collect():
        assert r.a_idx == (3 if r.a == "hot" else 0) and r.b_idx == (3 if r.b is None else 0)
    assert encode.apply_index_maps_wide(rows.limit(0), maps, ["a", "b"]).count() == 0
    none = encode.build_index_maps(train.limit(0), ["a", "b"])
    assert {(r.a_idx, r.b_idx) for r in encode.apply_index_maps_wide(rows, none, ["a", "b"]).collect()} == {(0, 0)}
