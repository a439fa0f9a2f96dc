"""Transactions made from the ``events`` table by a fixed rule, with the columns of a payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Categories in turn; the last two are unknown ones. Fixed values.
CATEGORIES = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "9999", "0000"]
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``embeddings`` as labelled vectors: orig_id, vector, label (1 for classes 0 to 2)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("orig_id"), F.col("embedding").alias("vector"), (F.col("label") < 3).cast("int").alias("label"))


def transactions(rows: DataFrame) -> DataFrame:
    """event_id, label (1: the event is an error) and the payload columns of each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id") % 10
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))

    def real(x: Column) -> Column:
        return x.cast("float")

    return rows.withColumns({"k": k, "before": before}).select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("event_id").cast("string").alias("id"),
        F.struct(real(F.col("value") * 20).alias("amount"), (F.col("event_id") % 12 + 1).alias("installments"), F.date_format("ts", STAMP).alias("requested_at")).alias("transaction"),
        F.struct(
            real((F.col("user_id") % 40 + 1) * 25).alias("avg_amount"),
            (F.col("event_id") % 23).alias("tx_count_24h"),
            F.array(*[x.cast("string") for x in (u, (u + 1) % 10, (u + 3) % 10)]).alias("known_merchants"),
        ).alias("customer"),
        F.struct(
            (F.col("k") % 10).cast("string").alias("id"), F.get(F.array(*map(F.lit, CATEGORIES)), F.col("k") % 12).alias("mcc"), real((F.col("k") + 1) * 30).alias("avg_amount")
        ).alias("merchant"),
        F.struct(
            F.col("event_type").isin("click", "view").alias("is_online"),
            (F.col("event_type") == "purchase").alias("card_present"),
            real((F.col("event_id") % 1300).cast("double") * 0.8).alias("km_from_home"),
        ).alias("terminal"),
        F.when(
            F.col("before").isNotNull(),
            F.struct(F.date_format("before", STAMP).alias("timestamp"), real((F.col("event_id") % 700).cast("double") * 1.7).alias("km_from_current")),
        ).alias("last_transaction"),
    )
