"""Tables in the shared folder of the cluster, used to cut lineage between steps."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a private one only where it is unset in local mode."""
    conf = spark.sparkContext.getConf()
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="skylattice-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor then costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skylattice_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._skylattice_path
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected its references to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_for(df: DataFrame, partition_bytes: int = 128 << 20) -> int:
    """Partitions for a shuffle whose number is fixed by hand: the session's, or more where the plan's size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, -(-size // partition_bytes)))


def fits_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> bool:
    """Whether a table (materialised, or cheap to count) has so few rows and bytes (as JSON) that it may be broadcast."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_small(big: DataFrame, small: DataFrame, on: Column | list[str] | str, how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """Join a table that is expected to be small: broadcast when its counted rows and bytes allow, else a shuffled join,
    which adaptive execution splits where a key is frequent."""
    return big.join(F.broadcast(small) if fits_broadcast(small, max_rows) else small, on, how)
