"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: let a skewed shuffle partition be split even when the split costs an extra shuffle later.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The form queries raise it (plans/standins.py); the corpus operators sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0b",
    # Some form queries let rows that lie together by some of a join's keys stay there (plans/standins.py).
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Explodes here read arrays built by long expressions; an inferred "array is not empty" filter would be pushed
    # below the projection that builds the array and evaluate the whole expression a second time.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def build_session(master: str = "local[*]", app: str = "gridmend", shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on to a session someone else built."""
    for key, value in RUNTIME_CONF.items():
        if key.endswith("excludedRules"):
            have = [r for r in (spark.conf.get(key, "") or "").split(",") if r]
            value = ",".join(dict.fromkeys([*have, value]))
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder already set.

    Only a local session, whose executors live in this process, gets a scratch folder where none is named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder shared by driver and executors in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage (a lost executor rereads files), and gives the optimizer the true size, on which it decides
    whether a side may be broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gridmend-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
