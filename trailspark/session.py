"""Session settings, the shared scratch folder, and the files of a store that Spark can reach."""

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Event times are UTC without zone; zoned casts must agree with that."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the storage all executors see.

    Where the setting is absent, a local temporary folder takes its place on a
    single machine; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/trailspark"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Files: folder first, then names below it -------------------------------------


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, *parts: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    store, folder = _store(spark, parts[0]), _path(spark, *parts)
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def delete(spark: SparkSession, *parts: str) -> None:
    _store(spark, parts[0]).delete(_path(spark, *parts), True)


def read_json(spark: SparkSession, *parts: str) -> dict:
    stream = _store(spark, parts[0]).open(_path(spark, *parts))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_json(spark: SparkSession, value: dict, *parts: str) -> bool:
    """Write a small file aside and rename it: whole from one moment on. False if there is
    one of that name."""
    store = _store(spark, parts[0])
    aside = _path(spark, *parts[:-1], f".{uuid.uuid4().hex}")
    stream = store.create(aside, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    return store.rename(aside, _path(spark, *parts))
