"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings only; memory, executors and shuffle width belong to the cluster.
RUNTIME_CONF = {
    # Log times are zone-less UTC text.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # "First/last n per group" stays a per-split limit up to the largest tail (100,000 lines).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
