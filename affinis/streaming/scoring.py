"""Incremental scoring: newly arrived queries against static actives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.similarity import Params, loo_scores, similarity_candidates, topk_features


def score_arrivals(spark: SparkSession, source: DataFrame, actives: DataFrame, targets: DataFrame, coefficients: DataFrame, p: Params, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Scores each micro-batch of a stream of queries and hands the ranked rows to ``sink(frame, batch_id)``.

    The sink may see a batch again after a failure, under the same id, so it should replace what it has of that id.
    """

    def batch(queries: DataFrame, batch_id: int) -> None:
        features = topk_features(similarity_candidates(queries, actives, p, same_target=False), p)
        sink(loo_scores(features, queries.select("query_id", "heavy_atoms"), targets, coefficients), batch_id)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_measurements(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Per target and day of arrival the number of measurements; late rows count while the watermark lets them."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", "1 day").alias("day"), "target_chembl_id").agg(F.count(F.lit(1)).alias("n_rows"))
