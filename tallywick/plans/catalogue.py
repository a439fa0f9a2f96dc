"""The queries of the scoring engine over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.fixedpoint import DIMENSIONS, columns, quantised
from ..operators import policy
from ..operators.decision import decision, vote
from ..operators.features import category_risk, known_merchant, quantised_transactions
from ..operators.neighbours import all_distances, nearest
from ..operators.partitioner import balanced, cluster_stats, widest
from ..operators.probing import box_repaired, fraud_counts, probe_ranks, probed
from ..sources import index as index_store
from ..sources import references
from ..sources.fixture import events, transactions, vectors
from ..sources.payload import PAYLOAD, as_json, parsed
from ..streaming.score import start
from .cases import BOXED, GRAMMAR
from .score import score_exact, score_payloads
from .stage import stage_path, staged

#: A search asks for every row whose id is divisible by this, among all rows.
EVERY = 100
D, Q = columns("d"), columns("q")
SMALL = 4
CLUSTERS = 16
DEFAULT_CLUSTERS = 256


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as quantised rows: orig_id, label, d0 to d13."""
    return vectors(spark, sf_dir).select("orig_id", "label", *quantised(F.col("vector"), "d"))


def _queries(rows: DataFrame, key: str = "orig_id") -> DataFrame:
    return rows.filter(F.col(key) % EVERY == 0).select(F.col(key).alias("qid"), *[F.col(d).alias(q) for d, q in zip(D, Q, strict=True)])


def tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised_transactions(transactions(events(spark, sf_dir)), ["event_id"], "q")


def quantize_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("orig_id").alias("vec_id"), *quantised(F.col("vector"), "q"))


def mcc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(events(spark, sf_dir)).select("event_id", F.col("merchant.mcc").alias("mcc"), F.round(category_risk(F.col("merchant.mcc")) * 100).cast("int").alias("risk_percent"))


def known_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(events(spark, sf_dir)).select("event_id", known_merchant(F.col("merchant.id"), F.col("customer.known_merchants")).alias("known"))


def minutes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(events(spark, sf_dir))
    return rows.select("event_id", calendar.minutes_between(F.col("transaction.requested_at"), F.coalesce("last_transaction.timestamp", F.lit(""))).alias("minutes"))


def hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("transaction.requested_at")
    return transactions(events(spark, sf_dir)).select("event_id", calendar.hour(at).alias("hour"), calendar.weekday(at).alias("weekday"))


def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(events(spark, sf_dir)).select("event_id", as_json([f.name for f in PAYLOAD.fields]).alias("body"))
    return parsed(rows, "body").select(
        "event_id", "parse_ok", F.col("transaction.installments").alias("installments"), F.col("transaction.requested_at").alias("requested_at"),
        F.col("customer.tx_count_24h").alias("tx_count_24h"), F.array_join("customer.known_merchants", ",").alias("known"), F.col("merchant.id").alias("merchant"),
        F.col("merchant.mcc").alias("mcc"), F.col("terminal.is_online").alias("is_online"), F.col("terminal.card_present").alias("card_present"),
        F.col("last_transaction").isNotNull().alias("has_last"),
    )


def payload_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that try each rule of the grammar: whether they are taken, and some of what is read."""
    rows = spark.createDataFrame(list(enumerate(GRAMMAR)), "case_id int, body string")
    return parsed(rows).select(
        "case_id", "parse_ok", F.col("transaction.installments").alias("installments"), F.round(F.col("transaction.amount") * 100).cast("int").alias("cents"),
        F.array_join("customer.known_merchants", ",").alias("known"), F.col("merchant.id").alias("merchant"), F.col("merchant.mcc").alias("mcc"),
        F.col("terminal.is_online").alias("is_online"), F.col("last_transaction").isNotNull().alias("has_last"),
    )


def pairwise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reference(spark, sf_dir)
    return all_distances(_queries(rows), rows, DIMENSIONS).select("qid", F.col("orig_id").alias("nid"), "dist")


def knn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reference(spark, sf_dir)
    return nearest(_queries(rows), rows, DIMENSIONS).select("qid", "rank", F.col("orig_id").alias("nid"), "dist")


def knn5_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reference(spark, sf_dir)
    return score_exact(_queries(rows), rows).drop("fraud_score")


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(quantised_transactions(transactions(events(spark, sf_dir)), ["event_id", "label"]).withColumnRenamed("event_id", "orig_id"), "transactions")


def score_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: transactions from events, scored by their nearest labelled neighbours."""
    rows = _transactions(spark, sf_dir)
    return score_exact(_queries(rows), rows).withColumnRenamed("qid", "event_id")


def max_variance_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widest(_reference(spark, sf_dir).withColumn("one", F.lit(0)), "one", DIMENSIONS).select("dim")


def split_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(_reference(spark, sf_dir), DIMENSIONS, SMALL).select(F.col("orig_id").alias("vec_id"), "cluster_id")


def cluster_stats_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_stats(balanced(_reference(spark, sf_dir), DIMENSIONS, SMALL), DIMENSIONS)


def _small_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, index_store.Index]:
    rows = _reference(spark, sf_dir)
    built = index_store.build(rows, DIMENSIONS, SMALL)
    return _queries(rows), replace(built, clusters=staged(built.clusters, "clusters"), apart=True)


def top_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = _small_index(spark, sf_dir)
    return probe_ranks(queries, index).select("qid", "probe_rank", "cluster_id", "dist")


def ivf_probe_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of other rows from the two nearest of four clusters."""
    queries, index = _small_index(spark, sf_dir)
    return vote(probed(queries, staged(probe_ranks(queries, index), "probe-ranks"), index, 2), queries)


def bbox_repair_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes from the nearest of four clusters and every cluster whose box may hold a nearer row: the exact answer."""
    queries, index = _small_index(spark, sf_dir)
    ranks = staged(probe_ranks(queries, index), "probe-ranks")
    counts = vote(box_repaired(queries, probed(queries, ranks, index, 1), ranks, index, 1), queries)
    return counts.select("qid", "fraud_count", (F.col("fraud_count") < 3).alias("approved"))


def policy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_features(spark, sf_dir).select(
        "event_id", policy.approval_repair().alias("approval_repair"), policy.boundary_approval().alias("boundary_approval"), policy.late_denial().alias("late_denial"),
        policy.denial_repair().alias("denial_repair"), policy.ambiguous(F.lit(1)).alias("ambiguous_at_1"), policy.ambiguous(F.lit(3)).alias("ambiguous_at_3"),
    )


def ivf_faithful_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search policy over transactions, in an index of 16 clusters with two probes, then four."""
    rows = _transactions(spark, sf_dir)
    built = index_store.build(rows, DIMENSIONS, CLUSTERS)
    index = replace(built, clusters=staged(built.clusters, "clusters"), probes=2, ambiguous_probes=4, most_probes=8, apart=True)
    return fraud_counts(_queries(rows), index)


def ivf_default_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole policy with the default search - 8 probes, then 24, then 128 - in 256 clusters.

    Besides every hundredth transaction there is one query in each box of the policy's predicates.
    """
    rows = _transactions(spark, sf_dir)
    built = index_store.build(rows, DIMENSIONS, DEFAULT_CLUSTERS)
    asked = spark.createDataFrame([(-1 - i, *q) for i, q in enumerate(BOXED)], "qid long, " + ", ".join(f"{q} int" for q in Q))
    queries = staged(_queries(rows).unionByName(asked), "queries")
    return fraud_counts(queries, replace(built, clusters=staged(built.clusters, "clusters"), apart=True))


def _payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, index_store.Index]:
    """Every hundredth transaction as JSON text, and an index over the others."""
    rows = _transactions(spark, sf_dir)
    built = index_store.build(rows.filter(F.col("orig_id") % EVERY != 0), DIMENSIONS, CLUSTERS)
    index = replace(built, clusters=staged(built.clusters, "clusters"), probes=2, ambiguous_probes=4, most_probes=8)
    # The time before is that of the event before, asked or not, so it is worked out first.
    found = transactions(events(spark, sf_dir)).filter(F.col("event_id") % EVERY == 0)
    return found.select("event_id", as_json([f.name for f in PAYLOAD.fields]).alias("body")), index


def payload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads from parsing to the answer, by the exact mode of the search."""
    bodies, index = _payloads(spark, sf_dir)
    broken = spark.createDataFrame([(-1, "no json"), (-2, None), (-3, '{"merchant":{"mcc":5411}}')], "event_id long, body string")
    return score_payloads(bodies.unionByName(broken), index, key="event_id", mode="exact").drop("fraud_score")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads as a stream of micro-batches, by the stepwise search; each batch is written under its number."""
    bodies, index = _payloads(spark, sf_dir)
    source, state, out = (stage_path(spark, f"stream-{x}") for x in ("source", "state", "scores"))
    bodies.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = start(stream, index, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), key="event_id", checkpoint=state)
    query.awaitTermination()
    return spark.read.parquet(out).select("event_id", "parse_ok", "fraud_count", "approved", "response")


def json_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written as a gzip JSON array, read back and quantised."""
    path = stage_path(spark, "references")
    references.write_json_array(vectors(spark, sf_dir).withColumn("vector", F.slice("vector", 1, DIMENSIONS)), path)
    return references.read_json_array(spark, path).select("orig_id", "label", *quantised(F.col("vector"), "q"))


def flat_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written as flat binary files, read back and quantised."""
    path = stage_path(spark, "flat")
    references.write_flat(vectors(spark, sf_dir), f"{path}/vectors.bin", f"{path}/labels.bin")
    return references.read_flat(spark, f"{path}/vectors.bin", f"{path}/labels.bin").select("orig_id", "label", *quantised(F.col("vector"), "q"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A systematic sample of 200 rows, 55 of 100 from class 1: a sampling operator."""
    return references.stratified(_reference(spark, sf_dir).select("orig_id", "label"), 200)


def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(6).select(F.col("id").cast("int").alias("fraud_count")).select("fraud_count", *decision(F.col("fraud_count")))


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, members and parameters of an index before and after it is saved and loaded."""
    built = index_store.build(_reference(spark, sf_dir), DIMENSIONS, CLUSTERS)
    index = replace(built, clusters=staged(built.clusters, "clusters"), probes=3, ambiguous_probes=5, most_probes=9)
    path = stage_path(spark, "index")
    index_store.save(index, path)
    back = index_store.load(spark, path, DIMENSIONS)

    def counted(i: index_store.Index, name: str) -> DataFrame:
        def sums(prefix: str) -> Column:
            return F.sum(sum((F.col(c).cast("long") * (n + 1) for n, c in enumerate(columns(prefix))), F.lit(0)) * (F.col("cluster_id") + 1))

        clusters = i.clusters.agg(
            F.lit(name).alias("version"), F.count("*").alias("clusters"), F.sum("n_rows").alias("n_rows"), *[sums(p).alias(f"sum_{p}") for p in ("c", "lo", "hi")],
            F.lit(i.probes).alias("probes"), F.lit(i.ambiguous_probes).alias("ambiguous_probes"), F.lit(i.most_probes).alias("most_probes"), F.lit(i.repair).alias("repair"),
        )
        members = i.members.agg(
            F.lit(name).alias("version"), F.count("*").alias("members"), F.sum("label").alias("labels"), F.sum(F.col("orig_id") * (F.col("cluster_id") + 1)).alias("sum_id"), sums("d").alias("sum_d")
        )
        return clusters.join(members, "version")

    return counted(index, "built").unionByName(counted(back, "loaded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        score_transactions, tx_features, quantize_embeddings, mcc_lookup, known_merchants, minutes_between, hour_weekday, payload_roundtrip, payload_grammar, pairwise_l2, knn5, knn5_vote,
        max_variance_dim, split_k4, cluster_stats_k4, top_centroids, ivf_probe_vote, bbox_repair_vote, policy_flags, ivf_faithful_vote, ivf_default_vote, payload_scores, stream_scores, json_references, flat_references, stratified_sample, decision_table,
        index_roundtrip,
    )
}
