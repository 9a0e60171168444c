"""Incremental runs: only documents whose text changed are worked on again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.plans.shared import materialize


def incremental(docs: DataFrame, work: Callable[[DataFrame], DataFrame], state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(results, state): `work` on changed and new documents, kept results for the rest, none for documents that are gone.

    state has doc_id, digest and one row of results a document as `results`
    (an array of structs); work must treat each document by itself and return
    rows with doc_id. The results equal those of a full run.
    """
    now = materialize(docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), "incoming")
    if state is None:
        stale, kept = now, None
    else:
        same = now.select("doc_id", "digest").join(state, ["doc_id", "digest"])
        kept = materialize(same, "kept")
        stale = now.join(kept.select("doc_id"), "doc_id", "left_anti")
    rows = work(stale.drop("digest"))
    other = [c for c in rows.columns if c != "doc_id"]
    fresh = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*other)).alias("results"))
    fresh = stale.select("doc_id", "digest").join(fresh, "doc_id", "left")
    new = materialize(fresh if kept is None else kept.select("doc_id", "digest", "results").unionByName(fresh), "state")
    return new.select("doc_id", F.inline("results")), new


def watch(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """A stream over a folder of Parquet files of documents: each batch's documents replace their earlier results under `out`, by document.

    Returns the started query, which ends once what is there is done.
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The results under `out`, of each document those of its last batch."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"]).drop("batch")
