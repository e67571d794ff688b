"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from tidelog.errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session, whose executors are its driver, gets a temporary one where none is set."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ConfigError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
