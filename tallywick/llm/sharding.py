"""Sharding through fixed virtual slots and a stored, versioned slot-to-shard map.

A record's slot is a hash of its id, size, checksum and number among equal records, and never changes. Bytes
are summed by slot, and a table of a few thousand rows says which shard a slot is in; rebalancing adds a
version of that table, and only the slots that it names move. All of it is DataFrame operations; what
reaches the driver is one row for each slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import no_null_text, stage_path, staged

SLOTS = 4096
SHARDS = 16
#: Cells of a slot in which rows are numbered apart, so that no task numbers more than a cell's rows.
CELLS = 16
#: Parts of the table in which equal records are counted apart.
PARTS = 4096

MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("virtual_slot", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
    ]
)


def digest_bits(key: Column) -> Column:
    """The first 28 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long")


def with_slots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, virtual_slot and cell of every row: a written table, so texts are read once.

    Equal records are numbered, so that even very many of them are spread over all slots. They are counted
    by parts of the table first, and no task numbers more of them than one part holds.
    """
    body = no_null_text(text).cast("binary")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.length(body) + 1, F.crc32(body)).alias("record"),
        F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("part"),
    )
    rows = staged(slim, "shard-rows")
    often = rows.groupBy("record", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("record").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    repeated = often.withColumn("of", F.sum("n").over(Window.partitionBy("record"))).filter("of > 1")
    offsets = repeated.select("record", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("record", "part").orderBy("size")) - 1
    numbered = rows.join(offsets, ["record", "part"]).withColumn("copy", F.col("offset") + at).drop("offset")
    single = rows.join(offsets.select("record").distinct(), "record", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    key = F.concat_ws("/", "record", F.when(F.col("copy") > 0, F.col("copy")))
    keyed = single.unionByName(numbered).withColumn("bits", digest_bits(key))
    placed = keyed.select(
        "doc_id", "size", "text_crc32", (F.col("bits") % slots).cast("int").alias("virtual_slot"), (F.floor(F.col("bits") / slots) % CELLS).cast("int").alias("cell")
    )
    return staged(placed, "shard-slots", instead_of=rows)


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def balanced_map(spark: SparkSession, loads: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first map: slots by falling bytes, each to the shard that has the fewest so far.

    ``loads`` (virtual_slot, bytes) has at most one row for each slot, a fixed number.
    """
    load = [0] * shards
    rows = []
    for slot, size in sorted(((r["virtual_slot"], r["bytes"]) for r in loads.collect()), key=lambda x: (-x[1], x[0])):
        shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += size
        rows.append((version, slot, shard, size))
    return spark.createDataFrame(rows, MAP_SCHEMA)


def rebalanced_map(spark: SparkSession, current: DataFrame, loads: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map for new loads or another number of shards, with few slots moved.

    Slots of shards that no longer exist, and new slots, go to the least shard; then slots move from the
    fullest shard to the emptiest while that one stays below it and the fullest is over (1 + slack) times
    the mean. ``current`` and ``loads`` have one row for each slot at most.
    """
    old = {r["virtual_slot"]: (r["shard"], r["version"]) for r in current.collect()}
    size = {slot: 0 for slot in old} | {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
    version = max((v for _, v in old.values()), default=0) + 1
    at = {slot: s for slot, (s, _) in old.items() if s < shards}
    load = [0] * shards
    for slot, s in at.items():
        load[s] += size[slot]
    for slot in sorted(size.keys() - at.keys(), key=lambda x: (-size[x], x)):
        at[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[at[slot]] += size[slot]
    mean = sum(load) / shards
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        movable = [slot for slot, s in at.items() if s == full and 0 < size[slot] < gap]
        if load[full] <= (1 + slack) * mean or not movable:
            break
        slot = min(movable, key=lambda x: (abs(gap - 2 * size[x]), x))
        at[slot] = empty
        load[full] -= size[slot]
        load[empty] += size[slot]
    return spark.createDataFrame([(version, slot, at[slot], size[slot]) for slot in sorted(at)], MAP_SCHEMA)


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to the table at ``path``; earlier versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position within the shard (from 0) of every row of ``with_slots``.

    Rows are numbered within their cell, by doc_id, size and checksum; cells are offset by the counts of
    the cells before them in the shard. Counts have one row for each cell, a fixed number, so they and
    the map are broadcast; no task sees more than the rows of a cell.
    """
    counts = rows.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n")).join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", "cell", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["virtual_slot", "cell"]).withColumn("slot", F.col("offset") + F.col("at")).drop("offset", "at", "cell")


def shard_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, version: int | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is ``bytes``: sizes of the shards are near equal; ``slot`` is the row's place in its shard,
    gapless from 0. Rows are placed by a stored map: a version of the one at ``map_path`` (the newest by
    default), or else a first version that is worked out for ``docs`` and written there, or to a new place.
    Slots that a given map lacks go by its shard count in turn. Null texts have size 1 and checksum 0; null
    ids count as empty strings; repeated ids and rows are spread like others, and equal rows are numbered
    one after the other. Very long texts are only measured. Empty tables give no rows. Extra columns are not
    read.
    """
    spark = docs.sparkSession
    rows = with_slots(docs, doc_id, text, slots)
    path = map_path or stage_path(spark, "slot-map")
    if not has_map(spark, path):
        write_map(balanced_map(spark, slot_bytes(rows), shards), path)
    slot_map = read_map(spark, path, version)
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    whole = every.join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot", "left")
    whole = whole.withColumns({"shard": F.coalesce("shard", F.col("virtual_slot") % shards), "version": F.coalesce("version", F.lit(version or 1))})
    return place(rows, whole).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def has_map(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
