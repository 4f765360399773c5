"""Small files and folders on whatever store Spark reaches."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession


def _path(spark: SparkSession, uri: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under ``spark.checkpoint.dir``, which all executors share, removed at exit. Without the setting
    local runs get a temporary folder; a cluster gets an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessitura-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        where, store = _path(spark, uri)
        store.delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
        return


def exists(spark: SparkSession, uri: str) -> bool:
    where, store = _path(spark, uri)
    return store.exists(where)


def folders(spark: SparkSession, uri: str) -> list[str]:
    """Names of the folders right under ``uri``, sorted; none where it does not exist."""
    where, store = _path(spark, uri)
    return sorted(s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()) if store.exists(where) else []


def read_json(spark: SparkSession, uri: str) -> dict:
    where, store = _path(spark, uri)
    stream = store.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish_json(spark: SparkSession, value: Mapping, uri: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed."""
    where, store = _path(spark, uri)
    aside, _ = _path(spark, f"{uri}.{uuid.uuid4().hex}.part")
    stream = store.create(aside)
    try:
        stream.write(bytearray((json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True) + "\n").encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    # one rename over what is there: no moment without a file, on stores that rename in one step
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(aside), store.makeQualified(where), options)
