"""Tables in the shared scratch folder: lineage ends at files that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sparkloom-"))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows dealt over all tasks by their key: a small file can hold rows that are much work, and is one task else."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def sorted_join(df: DataFrame) -> DataFrame:
    """Joined by sorting, never by broadcast: for sides that grow with the input, whose files say little of their size."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the scratch folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a frame made by :func:`cut`; only for frames nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
