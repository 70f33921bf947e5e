"""A ledger of outputs projected from order and line tables: an order is a transaction, a line an output, a day a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH = "1995-01-01"


def txo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs: tx_id, vout, creation_block, spent_block, value, script sizes, tx_coinbase, op_return, event, duration."""
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # a day's first order by a minimum, and as a membership test that goes where nobody asks for it
    marked = spark.sql("SELECT o_orderkey, o_orderdate, o_orderkey IN (SELECT min(o_orderkey) FROM {orders} GROUP BY o_orderdate) AS tx_coinbase FROM {orders}", orders=orders)
    tx = marked.select(F.col("o_orderkey").alias("tx_id"), F.datediff("o_orderdate", epoch).alias("day_c"), "tx_coinbase")
    in_order = Window.partitionBy("tx_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    out = (
        lines.withColumnRenamed("l_orderkey", "tx_id")
        .join(tx, "tx_id")
        .withColumn("vout", (F.row_number().over(in_order) - 1).cast("int"))
        .withColumn("day_s", F.datediff("l_shipdate", epoch))
    )
    age, part = F.col("day_s") - F.col("day_c"), F.col("l_partkey")
    life = F.when(part % 3 == 0, age % 12).when(part % 3 == 1, age).otherwise(age * 300)
    spent, created = F.col("day_s") >= F.col("day_c"), F.col("day_c") * 300
    scale = F.element_at(F.array(*(F.lit(10**k) for k in range(7))), F.least("l_linenumber", F.lit(7)).cast("int")).cast("long")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    scaled = cents * scale
    value = F.when(F.col("l_discount") == 0.0, F.lit(0).cast("long")).otherwise(((scaled - scaled % 1000) / 1000).cast("long"))
    size = F.element_at(F.array(*map(F.lit, (25, 23, 35, 67, 141))), (part % 5 + 1).cast("int"))
    return out.select(
        "tx_id", "vout", created.cast("int").alias("creation_block"), F.when(spent, created + life).cast("int").alias("spent_block"), value.alias("value"),
        size.cast("int").alias("locking_script_size"), F.when(spent, 107 + F.col("l_suppkey") % 40).cast("int").alias("unlocking_script_size"),
        "tx_coinbase", (F.col("l_discount") == 0.0).alias("op_return"), spent.alias("event"), F.when(spent, life).otherwise(F.lit(789_999) - created).cast("int").alias("duration"),
    )
