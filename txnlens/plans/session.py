"""Spark session defaults for this workload."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins/partition counts from
# runtime sizes and splits skewed join partitions; the static broadcast
# threshold is left to the explicit, size-checked broadcasts in ``broadcast``.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    # no call site is looked up for each column: half of the time a report takes to be defined
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "txnlens",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def size_shuffles(spark: SparkSession, raw: DataFrame, partition_bytes: int = 128 << 20) -> int:
    """Lets AQE start shuffles with one partition for every ``partition_bytes`` of the input files.

    AQE joins small partitions but cannot cut an ordinary one, so the number to start
    with has to grow with the input; it is never set below ``spark.sql.shuffle.partitions``.
    """
    size = int(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


def local_session(cpus: int | None = None, **kw) -> SparkSession:
    """A local test/bench session: ``local[cpus]`` with shuffle partitions = cpus."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    extra = {"spark.driver.memory": "8g"}
    extra.update(kw.pop("extra", {}) or {})
    return build_session(f"local[{cpus}]", cpus, extra=extra, **kw)
