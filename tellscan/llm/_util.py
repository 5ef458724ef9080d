"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if there is but one machine, else an error."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = _OWN.setdefault("dir", "") or "file://" + tempfile.mkdtemp(prefix="tellscan-shared-")
        _OWN["dir"] = set_dir
    return set_dir.rstrip("/")


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in replicated files, not in an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # shuffle files go once the driver has let go of the plans they fed
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete what save() wrote; nothing may read df, or what was made from it and not yet computed, after that."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def parallelism(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_key(text: Column) -> Column:
    """Stands for a text in row keys; null and empty differ."""
    return F.struct(F.xxhash64(text), F.length(text))
