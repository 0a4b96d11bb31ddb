"""Projection, filter, join, aggregation, window, set and reshape queries on the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import text as t
from ..operators import report, topics
from ..operators.models import fold, in_train
from ..sources.bank import read_table
from .registry import query


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN p_name WHEN 'Brand#2' THEN p_type WHEN 'Brand#3' THEN p_brand WHEN 'Brand#4' THEN p_name || p_type END AS key_answer FROM part")
def key_answer_case(spark, sf_dir):
    values = {"Brand#1": F.col("p_name"), "Brand#2": F.col("p_type"), "Brand#3": F.col("p_brand"), "Brand#4": F.concat("p_name", "p_type")}
    return read_table(spark, sf_dir, "part").select("p_partkey", scalar.case_when(F.col("p_brand"), values).alias("key_answer"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000 AND o_custkey IS NOT NULL")
def status_filter(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 1000) & F.col("o_custkey").isNotNull())
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), 'NA') || '/ ' || coalesce(p_name, 'NA') || '/ ' || p_size AS whole FROM part")
def na_concat(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", t.paste(F.nullif("p_type", F.lit("PROMO")), F.col("p_name"), F.col("p_size"), sep="/ ").alias("whole"))


@query("""SELECT l_orderkey, l_linenumber, (nullif(l_returnflag, 'N') = 'A')::INT AS same_flag, coalesce(nullif(l_returnflag, 'N'), 'none') AS filled, (l_quantity >= 25)::INT AS at_least,
  greatest(l_quantity - 25, 0.0) AS clamped, TRY_CAST(l_returnflag AS INT) AS as_number, TRY_CAST(l_linenumber::VARCHAR AS INT) AS renamed, 0.0::DOUBLE AS fixed FROM lineitem""")
def scalar_flags(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem")
    flag = F.nullif("l_returnflag", F.lit("N"))
    return line.select("l_orderkey", "l_linenumber", scalar.same_flag(flag, F.lit("A")).alias("same_flag"), F.coalesce(flag, F.lit("none")).alias("filled"), scalar.at_least(F.col("l_quantity"), 25).alias("at_least"), scalar.clamp_negative(F.col("l_quantity") - 25).alias("clamped"), F.col("l_returnflag").try_cast("int").alias("as_number"), F.col("l_linenumber").cast("string").try_cast("int").alias("renamed"), scalar.finite(F.lit(float("inf"))).alias("fixed"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_returnflag <> 'N') AS complete FROM lineitem")
def na_omit(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return line.agg(F.count(F.lit(1)).alias("n_rows")).join(line.dropna("any").agg(F.count(F.lit(1)).alias("complete")), F.lit(True))


@query("SELECT s_suppkey, s_nationkey, round((s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey)) / nullif(stddev_samp(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS z FROM supplier")
def z_standardise(spark, sf_dir):
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.round(scalar.zscore(F.col("s_acctbal"), "s_nationkey"), 6).alias("z"))


@query("SELECT o_orderkey, least(o_orderkey, o_custkey) || '-' || greatest(o_orderkey, o_custkey) AS pair_key, regexp_replace(o_orderpriority, '^[0-9]*-', '') AS stripped, round((o_totalprice + least(o_totalprice, 1000)) / 2, 6) AS row_mean FROM orders")
def pair_keys(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    mean = scalar.row_mean([F.col("o_totalprice"), F.least("o_totalprice", F.lit(1000)), F.lit(None)])
    return o.select("o_orderkey", t.pair_key(F.col("o_orderkey"), F.col("o_custkey")).alias("pair_key"), F.regexp_replace("o_orderpriority", "^[0-9]*-", "").alias("stripped"), F.round(mean, 6).alias("row_mean"))


@query("SELECT c_custkey, n_name, count(o_orderkey) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey, n_name")
def left_joins(spark, sf_dir):
    c, n, o = (read_table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    open_ = o.filter("o_orderstatus = 'O'")
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(open_, open_.o_custkey == c.c_custkey, "left")
    return out.groupBy("c_custkey", "n_name").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT a.n_name AS name_a, b.n_name AS name_b, (a.n_regionkey = b.n_regionkey)::INT AS same_region FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def attribute_pairs(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    a, b = (n.select(*(F.col(c).alias(f"{c}_{s}") for c in ("n_nationkey", "n_name", "n_regionkey"))) for s in ("a", "b"))
    both = a.join(b, F.col("n_nationkey_a") < F.col("n_nationkey_b"))
    return both.select(F.col("n_name_a").alias("name_a"), F.col("n_name_b").alias("name_b"), scalar.same_flag(F.col("n_regionkey_a"), F.col("n_regionkey_b")).alias("same_region"))


@query("SELECT a.k, x, y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k2, count(*) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k2")
def full_join(spark, sf_dir):
    a = read_table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    b = read_table(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k2")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, a.k == b.k2, "full_outer").select("k", "x", "y")


@query("SELECT 'c' AS kind, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_acctbal, s_name FROM supplier")
def row_append(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("balance"))
    s = read_table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c, s])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    c, s = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read_table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.union(s).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_filter(spark, sf_dir):
    big = read_table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    c = read_table(spark, sf_dir, "customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_filter(spark, sf_dir):
    done = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    c = read_table(spark, sf_dir, "customer")
    return c.join(done, c.c_custkey == done.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read_table(spark, sf_dir, "orders").withColumn("r", rn).filter("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_share(spark, sf_dir):
    by = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total), F.lit(True)).select("l_returnflag", "l_linestatus", "n", "mean_quantity", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT p_brand, string_agg(p_name, ' ' ORDER BY p_retailprice DESC, p_partkey) AS names FROM part GROUP BY p_brand")
def ordered_string_agg(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("w"), "p_partkey", "p_name")))
    return read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda x: x["p_name"]), " ").alias("names"))


@query("SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 6) AS cell, round(sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey), 6) AS row_sum, round(sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 6) AS col_sum FROM lineitem GROUP BY l_suppkey, l_returnflag")
def matrix_sums(spark, sf_dir):
    cells = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("cell"))
    sums = lambda k: F.round(F.sum("cell").over(Window.partitionBy(k)), 6)
    return cells.select("l_suppkey", "l_returnflag", F.round("cell", 6).alias("cell"), sums("l_suppkey").alias("row_sum"), sums("l_returnflag").alias("col_sum"))


@query("SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part QUALIFY rank <= 3")
def top_per_group(spark, sf_dir):
    return topics.top_per_group(read_table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", 3).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_ten(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)""")
def unpivot_metrics(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return line.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "metric", "value")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id""")
def pivot_counts(spark, sf_dir):
    kinds = ["click", "error", "view"]
    wide = read_table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return wide.select("user_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


@query("SELECT doc_id, item_id, ((doc_id * 7919 + item_id * 104729) % 100 < 70) AS is_train, doc_id % 5 + 1 AS fold FROM (SELECT doc_id, doc_id % 40 AS item_id FROM documents)")
def split_and_folds(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"))
    return d.select("doc_id", "item_id", in_train("doc_id", "item_id").alias("is_train"), fold("doc_id").alias("fold"))


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 7919) % 10007, o_orderkey LIMIT 500")
def row_sample(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").orderBy((F.col("o_orderkey") * 7919) % 10007, "o_orderkey").limit(500).select("o_orderkey")


def _stats(c: str) -> str:
    return f"count(*) AS {c}_count, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_sd, min({c}) AS {c}_min_value, max({c}) AS {c}_max_value, round(quantile_cont({c}, 0.25), 6) AS {c}_q1, round(quantile_cont({c}, 0.5), 6) AS {c}_median, round(quantile_cont({c}, 0.75), 6) AS {c}_q3"


@query(f"SELECT l_returnflag, {', '.join(map(_stats, ('l_quantity', 'l_extendedprice')))} FROM lineitem GROUP BY l_returnflag")
def desc_stats(spark, sf_dir):
    out = report.describe(read_table(spark, sf_dir, "lineitem"), "l_returnflag", ("l_quantity", "l_extendedprice"), stored=True)
    return out.select(*(F.round(c, 6).alias(c) if k == "double" and not c.endswith("_value") else F.col(c) for c, k in out.dtypes))


@query("SELECT threshold, count(*) FILTER (WHERE l_tax * 12 >= threshold) AS n, round(count(*) FILTER (WHERE l_tax * 12 >= threshold) / count(*), 6) AS perc FROM lineitem, (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) AS t(threshold) GROUP BY threshold")
def threshold_summary(spark, sf_dir):
    out = report.threshold_summary(read_table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_tax") * 12), "score")
    return out.withColumn("perc", F.round("perc", 6))


@query("SELECT doc_id AS id, (toxic * 7 + doc_id % 7) / 13.0::DOUBLE AS prob, ((toxic * 7 + doc_id % 7) / 13.0::DOUBLE >= 0.7)::INT AS enemy_07_rf, quality AS enemy_original, CASE WHEN (toxic * 7 + doc_id % 7) / 13.0::DOUBLE >= 0.7 OR quality = 1 THEN 1 ELSE 0 END AS enemy_yes FROM labels")
def relabel(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") * 7 + F.col("doc_id") % 7) / F.lit(13.0)).alias("prob"), F.col("quality").alias("enemy_yes"))
    return report.relabel(report.flags(rows, {"prob": "rf"}, (0.7,))).select("id", "prob", "enemy_07_rf", "enemy_original", "enemy_yes")


@query("SELECT * FROM nation")
def csv_round_trip(spark, sf_dir) -> DataFrame:
    """Written as CSV with a header under the warehouse folder and read with the same schema."""
    import uuid

    o = read_table(spark, sf_dir, "nation")
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/lexigrid-csv-{uuid.uuid4().hex}"
    from ..sources.bank import write_csv

    write_csv(o, path)
    return spark.read.schema(o.schema).option("header", True).csv(path)
