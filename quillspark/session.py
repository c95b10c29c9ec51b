"""Session defaults, and the one way the library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def get_spark(app: str = "quillspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset (tests), a temporary folder is set as it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_hand.isDefined():
            return set_by_hand.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Deletes a table written by keep() once nothing reads it any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes a core: a table smaller than this times the cores comes in too few partitions to keep them busy.
SMALL = 4 * 1024 * 1024


#: Bytes of the tables read for each task where rows are dealt out by a key.
PART = 16 * 1024 * 1024


def _read_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by the planner's estimate."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, by a hash of `keys`, where the tables it reads are small by the planner's estimate; larger ones come in enough partitions and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if _read_bytes(df) < SMALL * cores else df


def deal(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt out by a hash of `keys`, to each core as often; in the session's number of partitions where the planner has no estimate."""
    size, cores = _read_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * (1 + size // (PART * cores)), *keys) if size < 2**50 else df.repartition(*keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
