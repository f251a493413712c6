"""Session settings that the engine's results rest on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC, so that timestamps print and bucket alike everywhere; RocksDB, so that keyed state may exceed memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
}


def session(name: str = "rivulet", **settings: str) -> SparkSession:
    """The active session or a new one, with SETTINGS; settings: further ones, with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """SETTINGS on a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def keyed_state(spark: SparkSession) -> None:
    """RocksDB in the place of Spark's default state store, which holds one state variable a key only. Another store that is
    set stays, and a query that goes on from a checkpoint keeps that of the checkpoint."""
    store = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(store).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(store, SETTINGS[store])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. On a local master where that isn't set, a
    temporary one: there is one machine only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rivulet-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
