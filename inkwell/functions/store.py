"""Written intermediates: they end lineage, and what several stages need is worked out once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a temporary folder of this process, on a local master only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="inkwell-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str, schema=None, **options) -> DataFrame:
    """df, written and read back; schema: of the columns as they are read, where user-defined types stand for structs."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema if schema is None else schema).parquet(path)
