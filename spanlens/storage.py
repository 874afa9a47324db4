"""Where intermediate tables go: a folder that the driver and every executor share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may go without that setting, as in tests; any other
    is refused, for each machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        app = spark.sparkContext.applicationId
        root = _own_folders.get(app) or _own_folders.setdefault(app, tempfile.mkdtemp(prefix="run-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back, so that no later step computes it again or depends on
    the machines that made it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
