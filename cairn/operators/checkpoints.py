"""The folder that driver and executors share: checkpoints, which cut the lineage of iterative operators, and files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees that checkpoints have a folder: the cluster's own, or one made here in a purely local session, as in tests."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    checkpoint_folder(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
