"""Spans derived from star-schema tables: a deterministic forest of known shape.

A customer is a trace with a root span, orders are its children, lines theirs.  A line
lasts as long as its quantity, an order one more than its lines, a customer two more
than its orders, so all times are exact multiples of one half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.operators.shared import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, pos, activity, detail, start, duration) of every customer, order and line.

    Lines are shuffled once to their orders, and once more, with the orders, to the
    customer; every later window on trace_id finds the rows in place.  The number of
    partitions of every shuffle grows with the tables: joins and sums find one side where its
    keys lie already, and the other follows it.  No join of lines or orders is a broadcast, which
    small files of many rows would tempt to.  What follows from the level is made behind the shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tasks = tasks_for(spark, lines, orders, customers)
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines, customers = lines.where("l_orderkey is not null").repartition(tasks, "l_orderkey"), customers.repartition(tasks, "c_custkey")
    busy = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("busy"))
    lines = lines.withColumn("before", F.coalesce(F.sum("l_quantity").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("nth", F.row_number().over(in_order))
    rows = orders.join(busy.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", (F.lit(1.0) + F.coalesce("busy", F.lit(0.0))).alias("length"))
    rows = rows.join(customers.select(F.col("c_custkey").alias("o_custkey")).hint("merge"), "o_custkey", "left_semi")
    ahead = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition(tasks, "o_custkey").withColumn("begin", F.lit(2.0) + F.coalesce(F.sum("length").over(ahead), F.lit(0.0)))
    none = F.lit(None)
    line_spans = lines.join(rows.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("trace_id"), F.lit(0).alias("level"), F.col("o_orderkey").alias("k1"), F.col("nth").cast("bigint").alias("k2"),
        F.col("l_partkey").cast("bigint").alias("part"), none.cast("string").alias("name"), (F.col("begin") + 0.5 + F.col("before")).alias("start"), F.col("l_quantity").alias("duration"),
    )
    order_spans = rows.select(F.col("o_custkey").alias("trace_id"), F.lit(1).alias("level"), F.col("o_orderkey").alias("k1"), F.lit(0).cast("bigint").alias("k2"), none.cast("bigint").alias("part"), none.cast("string").alias("name"), F.col("begin").alias("start"), F.col("length").alias("duration"))
    total = rows.groupBy("o_custkey").agg(F.sum("length").alias("busy"))
    customer_spans = customers.join(total.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("trace_id"), F.lit(2).alias("level"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        none.cast("bigint").alias("part"), F.col("c_name").alias("name"), F.lit(1.5).alias("start"), (F.lit(2.0) + F.coalesce("busy", F.lit(0.0))).alias("duration"),
    )
    spans = line_spans.unionByName(order_spans).unionByName(customer_spans).repartition(tasks, "trace_id")
    order = Window.partitionBy("trace_id").orderBy(F.col("start") + F.col("duration"), "level", "k1", "k2")
    level = F.col("level")
    activity = F.when(level == 0, "Line").when(level == 1, "Order").otherwise("Customer")
    detail = F.when(level == 0, F.col("part").cast("string")).when(level == 1, F.col("k1").cast("string")).otherwise(F.col("name"))
    return spans.select("trace_id", (F.row_number().over(order) - 1).alias("pos"), activity.alias("activity"), detail.alias("detail"), "start", "duration")


#: The same spans in DuckDB SQL, as the beginning of a with clause.
SPANS_SQL = """
with l0 as (select l_orderkey, l_partkey, l_quantity,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as nth,
    coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0) as before
  from lineitem),
o0 as (select o_orderkey, o_custkey, 1.0::double + coalesce(busy, 0) as length
  from orders join customer on c_custkey = o_custkey left join (select l_orderkey, sum(l_quantity) as busy from l0 group by 1) on l_orderkey = o_orderkey),
o1 as (select *, 2.0::double + coalesce(sum(length) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as begin_at from o0),
s0 as (
  select o_custkey as trace_id, 0 as level, o_orderkey as k1, nth as k2, 'Line' as activity, l_partkey::varchar as detail, begin_at + 0.5::double + before as start, l_quantity as duration from o1 join l0 on l_orderkey = o_orderkey
  union all select o_custkey, 1, o_orderkey, 0, 'Order', o_orderkey::varchar, begin_at, length from o1
  union all select c_custkey, 2, 0, 0, 'Customer', c_name, 1.5::double, 2.0::double + coalesce(busy, 0) from customer left join (select o_custkey, sum(length) as busy from o1 group by 1) on o_custkey = c_custkey),
spans as (select trace_id, (row_number() over (partition by trace_id order by start + duration, level, k1, k2) - 1)::integer as pos, level, k1, activity, detail, start, duration, start + duration as end_at from s0)
"""
