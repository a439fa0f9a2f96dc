"""Labelled vectors: JSON arrays (plain or gzip), flat binary files, and samples of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixedpoint import DIMENSIONS

FRAUD_SHARE = 0.55


def read_json_array(spark: SparkSession, path: str, dimensions: int = DIMENSIONS, partitions: int | None = None) -> DataFrame:
    """orig_id, vector, label (1: "fraud", 0: any other) from a file that holds one JSON array.

    orig_id is the place in the array. Vectors are padded with zeros; longer ones are an error, as is text
    that is no such array. One such file is one task to parse, from its stream, so the rows are dealt out
    afterwards, and numbered before.
    """
    read = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("vector array<float>, label string").json(path)
    rows = read.withColumn("at", F.monotonically_increasing_id())
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    padded = F.slice(F.concat(F.coalesce("vector", zeros), zeros), 1, dimensions)
    checked = F.when(F.size("vector") > dimensions, F.raise_error(F.lit(f"a vector has more than {dimensions} items"))).otherwise(padded)
    found = rows.select(F.col("at").alias("orig_id"), checked.alias("vector"), (F.coalesce("label", F.lit("")) == "fraud").cast("int").alias("label"))
    return found.repartition(partitions) if partitions else found


def write_json_array(rows: DataFrame, path: str) -> None:
    """(orig_id, vector, label) by orig_id as one JSON array, gzip, in a folder at ``path``: one file, so one task writes it, row by row."""
    item = F.to_json(F.struct("vector", F.when(F.col("label") == 1, "fraud").otherwise("legit").alias("label")))
    first = rows.agg(F.min("orig_id")).first()[0]
    lines = rows.select(F.lit(1).alias("part"), "orig_id", F.concat(F.when(F.col("orig_id") != first, ",").otherwise(""), item).alias("line"))
    ends = rows.sparkSession.createDataFrame([(0, 0, "["), (2, 0, "]")], "part int, orig_id long, line string")
    lines.unionByName(ends).orderBy("part", "orig_id").select("line").coalesce(1).write.option("compression", "gzip").text(path)


def read_flat(spark: SparkSession, vectors: str, labels: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """orig_id, vector, label from little-endian 32-bit floats and one label byte a row; the labels' length is the count."""
    both = spark.read.format("binaryFile").load([vectors, labels])
    of = both.select(F.when(F.input_file_name().endswith(vectors.rsplit("/", 1)[-1]), "vectors").otherwise("labels").alias("kind"), "content")
    one = of.groupBy().pivot("kind", ["vectors", "labels"]).agg(F.first("content"))

    def unpack(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for v, y in zip(batch["vectors"], batch["labels"], strict=True):
                n = len(y)
                flat = np.frombuffer(v, "<f4", count=n * dimensions).reshape(n, dimensions)
                yield pd.DataFrame({"orig_id": range(n), "vector": list(flat), "label": np.frombuffer(y, "u1").astype("i4")})

    return one.mapInPandas(unpack, "orig_id long, vector array<float>, label int")


def write_flat(rows: DataFrame, vectors: str, labels: str, dimensions: int = DIMENSIONS) -> None:
    """(orig_id, vector, label) by orig_id as the two files that ``read_flat`` reads, in whatever store Spark writes.

    Each is one file in order, so the rows pass through the driver, a partition at a time, and none is kept.
    Vectors are padded with zeros or cut.
    """
    import struct

    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (vectors, labels)]
    files = [p.getFileSystem(conf).create(p, True) for p in paths]
    held = bytearray(), bytearray()
    try:
        for row in rows.select("vector", "label").orderBy("orig_id").toLocalIterator(prefetchPartitions=True):
            held[0].extend(struct.pack(f"<{dimensions}f", *[*row["vector"], *[0.0] * dimensions][:dimensions]))
            held[1].append(row["label"])
            if len(held[0]) > 1 << 20:
                _flush(files, held)
        _flush(files, held)
    finally:
        for f in files:
            f.close()


def _flush(files: list, held: tuple[bytearray, bytearray]) -> None:
    for f, data in zip(files, held, strict=True):
        f.write(data)
        data.clear()


def exists(spark: SparkSession, *paths: str) -> bool:
    """Whether all paths exist, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return all(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def stratified(rows: DataFrame, budget: int, share: float = FRAUD_SHARE) -> DataFrame:
    """A systematic sample of about ``budget`` rows of (orig_id, label): every n-th row of each class.

    ``share`` of the budget goes to label 1 as far as there are rows, the rest to others. Columns are the
    rows' and ``position``: the place in the output, where the classes take turns, label 1 first. A class
    without budget gives no rows. Places in a class come from counts of ranges of ids, so no task numbers
    more than a range.
    """
    ranked = numbered(rows.withColumn("stratum", (F.col("label") == 1).cast("int")), "stratum")
    sizes = {r["stratum"]: r["n"] for r in rows.groupBy((F.col("label") == 1).cast("int").alias("stratum")).agg(F.count("*").alias("n")).collect()}
    n_fraud, n_other = sizes.get(1, 0), sizes.get(0, 0)
    fraud = min(int(budget * share), n_fraud)
    other = min(budget - fraud, n_other)
    step = {1: n_fraud // fraud if fraud and n_fraud > fraud else 1, 0: n_other // other if other and n_other > other else 1}
    limit = F.when(F.col("stratum") == 1, fraud).otherwise(other)
    every = F.when(F.col("stratum") == 1, step[1]).otherwise(step[0])
    picked = ranked.filter((F.col("number") % every == 0) & (F.col("number") / every < limit))
    turn = F.col("number") * 2 + (1 - F.col("stratum"))
    return numbered(picked.withColumn("turn", turn).withColumn("all", F.lit(0)), "all", "turn").withColumnRenamed("number", "position").drop("all", "turn", "stratum").select(*rows.columns, "position")


def numbered(rows: DataFrame, group: str, order: str = "orig_id", ranges: int = 1024) -> DataFrame:
    """``rows`` with ``number``: the place (from 0) in the group by the numbers in ``order``, which are distinct within it.

    Rows are numbered within ranges of ``order``, which are offset by the counts of those before.
    """
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    width = max(1, -(-(high - low + 1) // ranges))
    cut = rows.withColumn("range_", F.floor((F.col(order) - low) / width))
    counts = cut.groupBy(group, "range_").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset_", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(group, "range_").orderBy(order)
    return cut.withColumn("at_", F.row_number().over(inside) - 1).join(offsets, [group, "range_"]).withColumn("number", (F.col("offset_") + F.col("at_")).cast("long")).drop("range_", "offset_", "at_")
