"""Plan shapes that matter at scale."""

import re

import __spark_entry__ as entry
from corpusloom.operators import lexical as L, ranking as R
from corpusloom.session import if_small, join_back
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    text = formatted(entry.queries()["filter_before_limit"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_orderdate" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_orderpriority" not in schema and "o_orderstatus" not in schema


def test_top_k_prunes_before_the_exchange(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("request_id"), F.col("id").alias("candidate"), F.rand(1).alias("score"))
    text = plan(R.top_candidates(rows))
    assert text.count("WindowGroupLimit") == 2 and text.index("WindowGroupLimit") < text.index("Exchange")
    terms = spark.createDataFrame([("r", "a")], "request_id string, term string")
    frequency = spark.createDataFrame([("a", 1)], "term string, df bigint")
    assert "WindowGroupLimit" in plan(L.rarest_terms(terms, frequency))


def test_broadcast_only_below_the_bound(spark):
    frame = spark.range(100)
    assert "broadcast" in if_small(frame, 100)._jdf.queryExecution().logical().toString().lower() or "hint" in if_small(frame, 100)._jdf.queryExecution().logical().toString().lower()
    assert if_small(frame, 99) is frame


def test_a_small_dictionary_does_not_move_the_features(spark):
    from corpusloom.operators.vectors import hashed_tfidf

    docs = spark.createDataFrame([(1, "light and shadow"), (2, "shadow")], "id int, text string").repartition(8)
    text = plan(hashed_tfidf(docs))
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_aggregates_join_back_through_fresh_exchanges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    reduced = rows.groupBy("k").agg(F.min("id").alias("first"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(rows.join(reduced, "k")).count("Exchange hashpartitioning") == 2
        assert plan(join_back(rows, reduced, ["k"])).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
