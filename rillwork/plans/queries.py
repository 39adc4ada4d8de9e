"""Queries of the general operators over the driver's tables. Oracles are in `oracle`."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf
from ..operators import aggregate as agg
from ..operators import clean, features, filters, joins, learn, project, rows, timeseries
from ..privacy import mask, perturb, suppress, verify
from ..privacy.fields import FieldSpec, Role
from ..session import local_folder
from ..sources import readers, writers
from ..streaming import windows as stream
from .oracle import oracle_sql  # noqa: F401
from .workflow import Workflow

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PRIVATE = [FieldSpec(0, "c_custkey"), FieldSpec(1, "c_name", role=Role.IDENTIFIER), FieldSpec(2, "c_nationkey", "INTEGER", Role.QUASIIDENTIFIER), FieldSpec(3, "c_acctbal", "DOUBLE", Role.SENSITIVE), FieldSpec(4, "c_mktsegment", role=Role.QUASIIDENTIFIER)]
QUASI = ["c_nationkey", "c_mktsegment"]
#: Added before rounding, here and in the oracles, so that halves go the same way in both.
EPS = 1e-9


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, table: str, columns: list[str] | None = None) -> Callable:
    """Register `f(df, spark, d)` as a query over a table (cut to `columns` first, so that the scan is)."""

    def register(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = _read(spark, d, table)
            return f(df.select(*columns) if columns else df, spark, d)

        _QUERIES[name] = run
        return f

    return register


def simple(name: str, table: str, op, columns: list[str] | None = None, after=None) -> None:
    """Register an operator over one table."""
    query(name, table, columns)(lambda df, spark, d: after(op(df)) if after else op(df))


# --- filters and projection ---
simple("filter_less_than", "lineitem", filters.filter_rows("l_quantity", "LESS_THAN", 10), ["l_orderkey", "l_linenumber", "l_quantity"])
simple("filter_equal", "part", filters.filter_rows("p_size", "EQUAL", 15), ["p_partkey", "p_size"])
simple("filter_large_equal", "part", filters.filter_rows("p_size", "LARGE_EQUAL", 45), ["p_partkey", "p_size"])
simple("filter_exist", "orders", filters.filter_rows("o_orderpriority", "EXIST", pattern="URGENT"), ["o_orderkey", "o_orderpriority"])
simple("filter_like", "part", filters.filter_rows("p_type", "LIKE", pattern="^[A-M].*E"), ["p_partkey", "p_type"])
simple("filter_sql", "customer", filters.filter_sql("c_custkey, c_acctbal * 2 as doubled", "c_acctbal > 5000 and c_mktsegment <> 'BUILDING'"))
simple("having_count", "orders", filters.filter_groups("o_custkey", "LARGE_EQUAL", 12), ["o_orderkey", "o_custkey"])
simple("having_sum", "orders", filters.filter_groups("o_custkey", "LARGE_THAN", 2_000_000, "SUM", "o_totalprice"), ["o_orderkey", "o_custkey", "o_totalprice"], lambda df: df.select("o_orderkey", "o_custkey"))
simple("topk", "orders", filters.top_k("o_totalprice", 20, False, ["o_orderkey"]), ["o_totalprice", "o_orderkey"])
simple("select_cols", "part", project.select_columns([0, 5], ["p_brand"]))
simple("select_ordered", "part", project.select_columns([0], order="p_size, p_partkey"))
simple("drop_cols", "supplier", project.drop_columns([1, "s_acctbal"]))
simple("rename_cols", "nation", project.rename_columns([("n_name", "nation"), ("nation", "land"), ("n_regionkey", "region")]))
simple("rename_positions", "nation", project.rename_by_position([{"index": 1, "name": "k", "type": "LONG"}, {"index": 2, "name": "name"}], first=1))
simple("cast_cols", "lineitem", project.cast_columns([("l_quantity", "INTEGER"), ("l_orderkey", "STRING"), ("l_returnflag", "DOUBLE")]), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])
simple("add_conditional", "orders", project.add_conditional("size", [("o_totalprice > 300000", "large"), ("o_totalprice > 100000", "medium"), ("o_totalprice <= 10000", "tiny")]), ["o_orderkey", "o_totalprice"], lambda df: df.select("o_orderkey", "size"))
simple("column_arith", "lineitem", lambda df: project.column_arithmetic(["l_quantity"], "MULTIPLY", constant=3)(project.column_arithmetic(["l_extendedprice", "l_quantity"], "DIVIDE", "unit")(df)).withColumn("unit", F.round(F.col("unit") + EPS, 6)), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])
simple("zone_ids", "supplier", project.add_zone_id("zone", "INCREMENTAL", ["s_acctbal", "s_suppkey"]), ["s_suppkey", "s_acctbal"], lambda df: df.select("s_suppkey", "zone"))
simple("concat_cols", "nation", project.concat_columns(["n_name", "n_regionkey"], "-", "joined", "REPLACE_SELECTED_WITH_RESULT"))
query("null_replace", "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])(lambda df, s, d: project.null_replace(True, True)(df.withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_mktsegment")))))
query("time_index", "orders", ["o_orderkey", "o_orderdate"])(lambda df, s, d: project.add_time_index("day", "yyyy/MM/dd HH:mm", "timestamp")(df.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm").alias("day"))).select("o_orderkey", F.unix_timestamp("timestamp").alias("epoch")))
query("drop_first_rows", "supplier", ["s_suppkey", "s_acctbal"])(lambda df, s, d: filters.drop_last(5, ["s_suppkey"])(filters.drop_first(10, ["s_suppkey"])(df)))

# --- aggregation ---
simple("aggregate_basic", "lineitem", agg.aggregate([("l_quantity", "AVERAGE"), ("l_extendedprice", "SUM"), ("l_orderkey", "COUNT")], ["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_orderkey"], lambda df: df.select("l_returnflag", "l_linestatus", F.round("l_quantity_avg", 6).alias("l_quantity_avg"), F.round("l_extendedprice_sum", 2).alias("l_extendedprice_sum"), "l_orderkey_count"))
simple("aggregate_concat", "nation", agg.aggregate([("n_name", "CONCATENATION")], ["n_regionkey"]))
simple("group_min_max_avg_sum_count", "events", agg.group_by(["event_type"], ["value"], ["MIN", "MAX", "AVG", "SUM", "COUNT"]), ["event_type", "value"], lambda df: df.withColumns({c: F.round(c, 4) for c in ("avg_value", "sum_value")}))


def _window_ends(df: DataFrame) -> DataFrame:
    start = F.col("window.start")
    return df.withColumn("start", F.unix_timestamp(start.cast("timestamp"))).drop("window")


simple("tumbling_window", "events", agg.group_by(["event_type"], ["value"], ["SUM", "COUNT"], {"key": "ts", "length": "1 hour"}), ["event_type", "value", "ts"], lambda df: _window_ends(df).withColumn("sum_value", F.round("sum_value", 4)))
simple("sliding_window", "events", agg.group_by([], ["value"], ["COUNT"], {"key": "ts", "length": "1 hour", "slide": "30 minutes"}), ["value", "ts"], _window_ends)
simple("window_all_columns", "events", agg.time_window_aggregate("1 day", "ts", ["value"], ["event_type"], "max"), ["event_type", "value", "ts"], _window_ends)
simple("window_median", "events", agg.time_aggregate("ts", "1 day", agg="MEDIAN"), ["value", "ts"], lambda df: df.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), F.round("value", 6).alias("value")))
simple("session_window", "events", agg.session_window(["user_id"], "ts", "30 minutes"), ["user_id", "ts"], lambda df: df.select("user_id", "events", F.unix_timestamp(F.col("session_start").cast("timestamp")).alias("session_start")))
simple("pivot_avg", "orders", agg.pivot(["o_orderpriority"], "o_orderstatus", "o_totalprice", values=["F", "O", "P"]), ["o_orderpriority", "o_orderstatus", "o_totalprice"], lambda df: df.withColumns({c: F.round(c, 4) for c in "FOP"}))
simple("pivot_sum", "orders", agg.pivot(["o_orderpriority"], "o_orderstatus", "o_totalprice", "SUM", ["F", "O", "P"]), ["o_orderpriority", "o_orderstatus", "o_totalprice"], lambda df: df.withColumns({c: F.round(c, 2) for c in "FOP"}))
simple("transpose_col", "region", agg.transpose("r_name", ["r_regionkey"]))
simple("freq_table", "part", agg.frequency(["p_brand", "p_size"]), ["p_brand", "p_size"])
simple("most_frequent", "part", agg.most_frequent("p_type"), ["p_type"])
simple("least_frequent", "part", agg.most_frequent("p_type", True), ["p_type"])
simple("describe_stats", "customer", agg.statistics("c_acctbal"), ["c_acctbal"], lambda df: df.select(*(F.round(c, 4).alias(c) for c in ("min", "max", "avg", "std", "median")), "count"))
simple("column_means", "lineitem", agg.column_means(), ["l_quantity", "l_discount", "l_tax"], lambda df: df.select(*(F.round(c, 6).alias(c) for c in df.columns)))
simple("ensemble_aggregate", "embeddings", lambda df: agg.ensemble_aggregate("outputs", "AVG", ["vec_id"])(df.select("vec_id", F.array(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double") * 3)).alias("outputs"))), None, lambda df: df.select("vec_id", F.posexplode("output")).select("vec_id", "pos", F.round("col", 5).alias("score")))
simple("flatten_arrays", "embeddings", agg.flatten_vectors("embedding", ["vec_id"], "flat", ["label"]), None, lambda df: df.select("label", F.size("flat").alias("n"), F.round(F.get("flat", F.lit(1)).cast("double"), 5).alias("second")))
simple("latest_message", "events", agg.latest_per_key("event_type", "event_id", "props"), ["event_type", "event_id", "props"])

# --- row windows, sets, samples ---
query("row_window_sliding", "orders", ["o_orderkey", "o_totalprice"])(lambda df, s, d: rows.sliding_rows(3, ["o_orderkey"], slide=2)(df).select("window_id", "o_orderkey"))
simple("row_window_tumbling", "orders", rows.tumbling_rows(100, ["o_orderdate", "o_orderkey"]), ["o_orderkey", "o_orderdate"], lambda df: df.select("window_id", "o_orderkey"))
query("row_window_groups", "orders", ["o_orderkey", "o_custkey"])(lambda df, s, d: rows.sliding_rows(2, ["o_orderkey"], groups=["o_custkey"])(df))


def _two(op):
    return lambda df, s, d: op(df.select("s_nationkey"), _read(s, d, "customer").select("c_nationkey"))


for _kind in ("UNION_ALL", "UNION", "INTERSECT", "EXCEPT"):
    query(_kind.lower(), "supplier")(_two(lambda a, b, k=_kind: filters.set_operation(k)(a, b)))
simple("sample_simple", "lineitem", filters.sample_simple(0.1, seed=7), ["l_orderkey", "l_linenumber"])
simple("sample_replacement", "part", filters.sample_simple(0.5, True, seed=7), ["p_partkey"])
simple("sample_stratified", "lineitem", filters.sample_stratified("l_returnflag", {"A": 0.1, "R": 0.3}, seed=7), ["l_orderkey", "l_linenumber", "l_returnflag"])

# --- joins ---
_C, _O = ["c_custkey", "c_nationkey"], ["o_orderkey", "o_custkey"]
for _name, _kind in (("join_inner", "INNER"), ("join_left", "LEFT_OUTER"), ("join_right", "RIGHT_OUTER"), ("join_full", "FULL_OUTER"), ("join_semi", "LEFT_SEMI"), ("join_anti", "LEFT_ANTI")):
    query(_name, "customer", _C)(lambda df, s, d, k=_kind: joins.join_columns([("c_custkey", "o_custkey")], k)(df, _read(s, d, "orders").select(*_O)))
query("join_multiway", "customer")(lambda df, s, d: joins.join_on_key("k", [["c_mktsegment"], ["n_name"], ["s_suppkey"]])(df.withColumnRenamed("c_nationkey", "k"), _read(s, d, "nation").withColumnRenamed("n_nationkey", "k"), _read(s, d, "supplier").withColumnRenamed("s_nationkey", "k")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n")))
query("broadcast_join", "customer", ["c_custkey", "c_nationkey"])(lambda df, s, d: joins.broadcast_join([("c_nationkey", "n_nationkey")])(df, _read(s, d, "nation")).select("c_custkey", "n_name"))
query("join_interval", "events", ["event_id", "user_id", "ts"])(lambda df, s, d: joins.join_interval("user_id", "ts", "30 minutes")(df, df.select(F.col("event_id").alias("before_id"), "user_id", "ts")).select("event_id", "before_id"))
query("join_range", "orders", ["o_orderkey", "o_totalprice"])(lambda df, s, d: joins.join_range(None, "o_totalprice", "low", "high", 50_000)(df, _read(s, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 20).alias("high"))).select("o_orderkey", "p_partkey"))
query("join_asof", "events", ["event_id", "user_id", "ts"])(lambda df, s, d: joins.join_asof("user_id", "ts", ["event_id", "value"])(df.where("event_id % 2 = 0"), _read(s, d, "events").where("event_id % 2 = 1").select("event_id", "user_id", "ts", "value")).select("event_id", "event_id_right", "value"))
query("append_columns", "region")(lambda df, s, d: joins.append_columns([["r_regionkey"], ["n_nationkey"]])(df.select("r_regionkey", "r_name"), _read(s, d, "nation").select("n_nationkey", "n_name")))
query("merge_tables", "nation")(lambda df, s, d: joins.merge_tables(["CONCAT", "OUTER_JOIN"], "k")(df.select(F.col("n_regionkey").alias("k"), "n_name"), df.select(F.col("n_regionkey").alias("k"), F.lower("n_name").alias("n_name")), _read(s, d, "region").select(F.col("r_regionkey").alias("k"), "r_name").where("r_regionkey > 0")))


# --- cleaning ---
def _holes(df: DataFrame) -> DataFrame:
    """Nulls by expression, in both oracles and here."""
    return df.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))


simple("impute_drop", "events", lambda df: clean.impute("IM", ["value", "event_type"], "ALL")(_holes(df)))
simple("impute_constant", "events", lambda df: clean.impute("SPECIFIC_VALUE", ["value", "event_type"], numeric=-1.0, text="none")(_holes(df)))
simple("impute_median", "events", lambda df: clean.impute("MEDIAN", ["value"])(_holes(df)), None, lambda df: df.withColumn("value", F.round("value", 6)))
simple("impute_mean", "events", lambda df: clean.impute("MEAN", ["value"])(_holes(df)), None, lambda df: df.withColumn("value", F.round("value", 6)))
simple("equal_width_bin", "part", clean.equal_width_bins(["p_retailprice"], 4), ["p_partkey", "p_retailprice"], lambda df: df.select("p_partkey", F.col("p_retailprice_result").alias("bin")))
simple("equal_depth_bin", "part", clean.equal_depth_bins(["p_size"], 5), ["p_partkey", "p_size"])
simple("minmax_scale", "customer", clean.minmax_scale(["c_acctbal"], -1, 1), ["c_custkey", "c_acctbal"], lambda df: df.withColumn("c_acctbal", F.round("c_acctbal", 8)))
simple("minmax_declared", "customer", clean.minmax_scale(["c_acctbal"], 0, 10, -1000, 10_000), ["c_custkey", "c_acctbal"], lambda df: df.withColumn("c_acctbal", F.round("c_acctbal", 8)))


def _daily(s: SparkSession, d: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("day")
    return _read(s, d, "orders").groupBy(day).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


for _method in ("linear", "previous", "nearest"):
    query(f"interpolate_{_method}", "orders")(lambda df, s, d, m=_method: timeseries.interpolate("day", 3, m.upper())(_daily(s, d)).select(F.col("day").cast("int").alias("day"), F.round(F.col("total") + EPS, 4).alias("total")))
query("time_sync", "orders")(lambda df, s, d: timeseries.time_synchronize("day", "day", 2, "PREVIOUS", 2)(_daily(s, d), _daily(s, d).withColumn("total", -F.col("total"))).select(F.col("time").cast("int").alias("time"), F.round("total", 2).alias("total"), F.round("total_right", 2).alias("total_right")))
query("explode_col", "documents", ["doc_id", "text"])(lambda df, s, d: project.explode_column("part", "line")(df.select("doc_id", F.split("text", "\n").alias("part"))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")))
query("split_array", "embeddings", ["vec_id", "embedding"])(lambda df, s, d: project.split_column("embedding", width=4)(df).select("vec_id", *(F.round(F.col(f"embedding{i}").cast("double"), 5).alias(f"embedding{i}") for i in range(4))))
query("split_struct", "nation")(lambda df, s, d: project.split_column("s")(df.select("n_nationkey", F.struct(F.col("n_name").alias("a"), (F.col("n_regionkey") + 1).alias("b")).alias("s"))))
query("json_props", "events", ["event_id", "props"])(lambda df, s, d: df.select("event_id", F.from_json("props", "k int")["k"].alias("k")))

# --- features and learning ---
_PART = ["p_partkey", "p_size", "p_retailprice", "p_brand"]
query("string_index", "part", ["p_partkey", "p_brand"])(lambda df, s, d: features.string_index([("p_brand", "ix")])(df).select("p_partkey", "ix"))
query("one_hot", "region")(lambda df, s, d: features.one_hot("r_name")(df).select("r_name", F.col("r_nameVec").cast("string").alias("vec")))
query("vectorize", "part", _PART)(lambda df, s, d: features.vectorize("v", ["p_size", "p_retailprice"], False)(df).select("p_partkey", F.col("v").cast("string").alias("v")))
query("vectorize_all", "supplier", ["s_suppkey", "s_acctbal"])(lambda df, s, d: features.vectorize_all("v")(df).select("s_suppkey", F.col("v").cast("string").alias("v")))
query("chi_square", "lineitem", ["l_linenumber", "l_quantity", "l_discount", "l_tax"])(lambda df, s, d: features.chi_square_select("l_linenumber", 2)(df))
query("pca", "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])(lambda df, s, d: features.pca(2)(df))
query("decision_tree_select", "lineitem", ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"])(lambda df, s, d: features.tree_select("l_linestatus", 4)(df))
query("stepwise_forward", "lineitem", ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])(lambda df, s, d: features.stepwise_forward("l_extendedprice")(df))
query("stepwise_backward", "lineitem", ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])(lambda df, s, d: features.stepwise_backward("l_extendedprice")(df))
query("linear_regression", "lineitem", ["l_extendedprice", "l_quantity"])(lambda df, s, d: learn.linear_regression("l_extendedprice")(df).withColumn("weight", F.round("weight", 4)))
query("glm", "lineitem", ["l_extendedprice", "l_quantity", "l_discount"])(lambda df, s, d: learn.generalized_regression("l_extendedprice", "GAUSSIAN", "LOG", 10)(df.where("l_extendedprice > 0")))
query("kmeans", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])(lambda df, s, d: learn.kmeans(3, 20, 7, ["l_quantity", "l_discount"])(df))
query("gaussian_mixture", "customer", ["c_custkey", "c_acctbal"])(lambda df, s, d: learn.gaussian_mixture(2, 20, 7, ["c_acctbal"])(df))
query("kmedoids", "customer", ["c_custkey", "c_acctbal"])(lambda df, s, d: learn.kmedoids(3, 3, 7, ["c_acctbal"])(df))
query("dbscan", "customer", ["c_custkey", "c_acctbal", "c_nationkey"])(lambda df, s, d: learn.dbscan(2.0, 4, "c_custkey", ["c_acctbal", "c_nationkey"])(df))
query("agglomerative", "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])(lambda df, s, d: learn.agglomerative(2, "AVERAGE", ["s_acctbal"], ["s_nationkey"])(df))

query("agglomerative_single", "customer", ["c_custkey", "c_acctbal"])(lambda df, s, d: learn.agglomerative(5, "SINGLE", ["c_acctbal"])(df))


def _shared(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: beside the checkpoints, in a place of its own only where there are none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/') if base else local_folder(spark)}/rillwork-{name}-{uuid.uuid4().hex}"


query("random_forest", "lineitem", ["l_quantity", "l_discount", "l_tax", "l_linestatus"])(lambda df, s, d: learn.random_forest_train("l_linestatus", _shared(s, "forest"), folds=2, trees=[5], depths=[3])(df))


@query("model_predict", "lineitem", ["l_quantity", "l_discount", "l_tax", "l_linestatus"])
def _model_predict(df: DataFrame, s: SparkSession, d: str) -> DataFrame:
    path = _shared(s, "forest")
    learn.random_forest_train("l_linestatus", path, folds=2, trees=[3], depths=[2])(df)
    return learn.model_predict(path)(df)


query("batch_predict", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])(lambda df, s, d: learn.batch_predict(lambda pdf: pdf.assign(score=pdf.l_quantity * 2 + 1), "l_orderkey long, l_linenumber int, l_quantity double, score double")(df))

# --- privacy ---
_P = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_num = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
simple("priv_aggregate", "customer", mask.mask_aggregate(["c_acctbal"]), ["c_custkey", "c_acctbal"], lambda df: df.select("c_custkey", _num("c_acctbal")))
simple("priv_partial_aggregate", "customer", suppress.mask_outliers(["c_acctbal"]), ["c_custkey", "c_acctbal"], lambda df: df.select("c_custkey", _num("c_acctbal")))
simple("priv_partial_boxplot", "customer", suppress.mask_outliers(["c_acctbal"], "MAX", "BOXPLOT"), ["c_custkey", "c_acctbal"], lambda df: df.select("c_custkey", _num("c_acctbal")))
simple("priv_range", "customer", mask.mask_range(["c_acctbal"]), ["c_custkey", "c_acctbal"])
simple("priv_round", "customer", mask.mask_round(["c_nationkey"], 4, "ROUND"), ["c_custkey", "c_nationkey"])
simple("priv_round_up", "customer", mask.mask_round(["c_custkey"], 10, "ROUND_UP"), ["c_custkey", "c_name"])
simple("priv_round_text", "customer", lambda df: mask.mask_round(["t"], 100, "ROUND_DOWN")(df.select("c_custkey", F.concat(F.lit("No."), F.col("c_custkey").cast("string"), F.lit("x")).alias("t"))), ["c_custkey"])
simple("priv_hide", "customer", lambda df: mask.mask_hide(["t"], "MAX")(df.select("c_custkey", F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("t"))), ["c_custkey"])
simple("priv_blank", "customer", mask.mask_blank(["c_name"], [2, 6], 2), ["c_custkey", "c_name"])
simple("priv_generalize_num", "customer", mask.generalize([("c_nationkey", 3, 1)]), ["c_custkey", "c_nationkey"])
simple("priv_generalize_str", "customer", mask.generalize([("c_mktsegment", 4, 2)]), ["c_custkey", "c_mktsegment"])
simple("priv_hierarchy", "customer", mask.hierarchy("c_mktsegment", 3), ["c_mktsegment"])
simple("priv_drop_identifier", "customer", mask.drop_identifiers(PRIVATE), _P)
simple("priv_drop_quasi", "customer", mask.drop_quasi_identifiers(PRIVATE, ["nationkey"]), _P)
simple("priv_record_reduction", "customer", suppress.reduce_records(["c_acctbal", "c_mktsegment"]), ["c_custkey", "c_acctbal", "c_mktsegment"], lambda df: df.select("c_custkey", (F.col("c_acctbal") == "*").alias("gone"), "c_mktsegment"))
simple("priv_record_reduction_all", "customer", suppress.reduce_records(QUASI, together=True), ["c_custkey", *QUASI])
simple("priv_classes", "customer", suppress.equivalence_classes(QUASI), QUASI)
simple("priv_suppress_k", "customer", suppress.suppress_small_classes(QUASI, k=10), ["c_custkey", *QUASI])
simple("priv_suppress_risk", "customer", suppress.suppress_small_classes(QUASI, risk=0.11), ["c_custkey", *QUASI])
simple("priv_pseudonym", "customer", lambda df: perturb.reveal_pseudonyms("c_name", perturb.pseudonym_table(df, "c_name", key="k"))(perturb.pseudonymize("c_name", key="k")(df)), ["c_custkey", "c_name"])
simple("priv_encrypt", "customer", lambda df: perturb.decrypt(["c_name"], "secret", "SHA1")(perturb.encrypt(["c_name"], "secret", "SHA1")(df)), ["c_custkey", "c_name"])
simple("priv_encrypt_ecb", "customer", perturb.encrypt(["c_name"], "0123456789abcdef", mode="ECB"), ["c_custkey", "c_name"])
simple("priv_swap", "customer", perturb.swap_values("c_mktsegment"), ["c_custkey", "c_mktsegment"])
simple("priv_rearrange", "customer", perturb.rearrange(["c_acctbal"], ["c_custkey"], ratio=0.1), ["c_custkey", "c_acctbal"])
simple("priv_rearrange_manual", "customer", perturb.rearrange(["c_acctbal"], ["c_custkey"], pairs=[(0, 9), (3, 5)]), ["c_custkey", "c_acctbal"])
simple("priv_noise", "customer", perturb.add_noise(["c_acctbal"], "GAUSSIAN"), ["c_custkey", "c_acctbal"])
simple("priv_noise_fixed", "customer", perturb.add_noise(["c_acctbal"], "FIXED", "NOISE_MULTIPLY", 2.0), ["c_custkey", "c_acctbal"])
_V = ["c_nationkey", "c_mktsegment", "c_acctbal"]
_S = lambda df: df.withColumn("band", F.floor(F.col("c_acctbal") / 2500).cast("int"))
simple("k_anonymity", "customer", lambda df: verify.k_anonymity(df, QUASI, 5), _V)
for _name, _m in (("distinct", "DISTINCT"), ("prob", "PROBABILISTIC"), ("entropy", "ENTROPY")):
    simple(f"l_diversity_{_name}", "customer", lambda df, m=_m: verify.l_diversity(_S(df), QUASI, "band", m), _V, lambda df: df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns)))
simple("l_diversity_recursive", "customer", lambda df: verify.recursive_l_diversity(_S(df), ["c_nationkey"], "band", 2.0, 3), _V)
simple("t_closeness", "customer", lambda df: verify.t_closeness(_S(df), QUASI, "band"), _V, lambda df: df.select(F.round("t", 6).alias("t"), F.round("t_sum", 5).alias("t_sum")))
simple("loss_aecs", "customer", lambda df: verify.aecs_loss(df, QUASI), _V)
simple("loss_dm", "customer", lambda df: verify.discernibility(suppress.suppress_small_classes(QUASI, k=10)(df), QUASI), _V)
simple("loss_cardinality", "customer", lambda df: verify.cardinality_loss(df, mask.mask_round(["c_nationkey"], 5, "ROUND_DOWN")(df), QUASI), _V)
simple("loss_equivalence", "customer", lambda df: verify.equivalence_loss(df, mask.mask_round(["c_nationkey"], 5, "ROUND_DOWN")(df), QUASI), _V)
simple("loss_hierarchy", "customer", lambda df: verify.hierarchical_loss(mask.generalize([("c_mktsegment", 4, 2)])(df), {"c_mktsegment": mask.hierarchy("c_mktsegment", 4)(df)}), _V)
simple("risk_reid", "customer", lambda df: verify.reidentification_risk(df, QUASI), _V)
simple("risk_global", "customer", lambda df: verify.global_risk(df, QUASI), _V, lambda df: df.select(F.round("global_risk", 8).alias("global_risk")))


_check = verify.checked(suppress.suppress_small_classes(QUASI, k=10), QUASI, loss="AECS", risk="UNIQUENESS", model="K_ANONYMITY")
simple("priv_check", "customer", lambda df: _check(df)[1], _V)
query("priv_lattice", "region")(lambda df, s, d: s.createDataFrame([(n["c_mktsegment"], n["c_nationkey"], round(h, 6)) for n, h in mask.lattice({"c_nationkey": 3, "c_mktsegment": 2})], "c_mktsegment int, c_nationkey int, height double"))


# --- sources, sinks and workflows ---
@query("file_round_trip", "nation")
def _file_round_trip(df: DataFrame, s: SparkSession, d: str) -> DataFrame:
    path = _shared(s, "files")
    writers.file_writer(path, "CSV", delimiter=";")(df)
    return readers.file_reader([path], "CSV", ";", True, [("n_nationkey", "INTEGER"), ("n_name", "STRING"), ("n_regionkey", "INTEGER")])(s)


def _workflow(s: SparkSession, d: str) -> DataFrame:
    tables = [{"reader": "file", "paths": [f"{d}/{t}.parquet"], "kind": "PARQUET"} for t in ("supplier", "nation")]
    plan = {"engines": [{"id": 1, "readers": tables, "operators": [{"op": "join_columns", "pairs": [("s_nationkey", "n_nationkey")], "kind": "INNER"}, {"op": "filter_rows", "column": "s_acctbal", "condition": "LARGE_THAN", "value": 1000}, {"op": "select_columns", "names": ["s_suppkey", "n_name"]}]}]}
    return Workflow.load(plan).engines[0].frame(s)


_QUERIES["workflow_batch"] = _workflow
simple("order_by", "part", filters.order_by("p_size", False), ["p_partkey", "p_size"])
query("merge_inner", "nation", ["n_name", "n_regionkey"])(lambda df, s, d: joins.merge_tables(["INNER_JOIN"], "k")(df.withColumnRenamed("n_regionkey", "k"), _read(s, d, "region").select(F.col("r_regionkey").alias("k"), "r_name")))


# --- streams: the same operators over a file stream, run to the end ---
def streamed(spark: SparkSession, d: str, table: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run a plan as a streaming query over a table's files and return what it wrote.

    Append results go to files in the shared folder; complete ones are kept from the last micro-batch."""
    source = f"{d}/{table}.parquet"
    schema = spark.read.parquet(source).schema
    place = _shared(spark, f"stream-{table}")
    reader = spark.readStream.schema(schema)
    stream_df = reader.parquet(source) if os.path.isdir(source) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(d)

    def keep(df: DataFrame, batch: int) -> None:
        # a folder per batch: one that is run again writes the same folder again
        df.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={batch}")

    made = plan(stream_df)
    q = made.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(made.schema).parquet(f"{place}/out").select(*made.columns)


_QUERIES["stream_filter"] = lambda s, d: streamed(s, d, "events", lambda df: filters.filter_rows("value", "LARGE_THAN", 50)(df).select("event_id", "value"))
_QUERIES["stream_groupby_window"] = lambda s, d: _window_ends(streamed(s, d, "events", lambda df: agg.group_by(["event_type"], ["value"], ["COUNT", "SUM"], {"key": "ts", "length": "1 hour"})(stream.watermark("ts", "1 hour")(df)), "complete")).withColumn("sum_value", F.round("sum_value", 4))


def _interval(df: DataFrame) -> DataFrame:
    a = stream.watermark("ts", "2 hours")(df.select("event_id", "user_id", "ts"))
    b = stream.watermark("ts", "2 hours")(df.select(F.col("event_id").alias("before_id"), "user_id", "ts"))
    return joins.join_interval("user_id", "ts", "30 minutes")(a, b).select("event_id", "before_id")


_QUERIES["stream_interval_join"] = lambda s, d: streamed(s, d, "events", _interval)
_QUERIES["stream_count_window"] = lambda s, d: streamed(s, d, "events", lambda df: stream.count_windows(["user_id"], ["event_id"], 4, 2)(df.select("user_id", "event_id")))

# --- functions of one's own ---
query("udf_scalar", "nation")(lambda df, s, d: df.select("n_nationkey", udf.register_scalar(s, "shout", lambda x: f"{x}!", "string")("n_name").alias("loud")))


def _price_class(v: pd.Series) -> pd.Series:
    return (v // 100).astype("int64")


query("udf_pandas", "part", ["p_partkey", "p_retailprice"])(lambda df, s, d: df.select("p_partkey", udf.register_pandas(s, "price_class", _price_class, "long")("p_retailprice").alias("price_class")))
query("udaf_pandas", "part", ["p_brand", "p_retailprice"])(lambda df, s, d: df.groupBy("p_brand").agg(F.round(udf.register_pandas(s, "geometric_mean", udf.geometric_mean, "double")("p_retailprice"), 4).alias("mean")))


@query("udtf_split", "part", ["p_partkey", "p_name"])
def _udtf(df: DataFrame, s: SparkSession, d: str) -> DataFrame:
    udf.register_table(s, "split_words", udf.SplitWords, "position int, word string")
    return s.sql("select p_partkey, w.position, w.word from {p} p, lateral split_words(p.p_name) w", p=df)


query("route_lookup", "events", ["event_id"])(lambda df, s, d: df.select("event_id", udf.route_lookup((F.col("event_id") % 4).cast("int"), {0: "a", 1: "b", 2: "c"}).alias("route")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)

