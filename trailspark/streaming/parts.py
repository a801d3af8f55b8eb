"""Sinks that survive a replayed micro-batch, and fold what they wrote.

Each micro-batch writes its own ``batch_id=N`` folder and overwrites it when it
is run again, so a lost executor or a restart never counts a row twice.

Folders are folded in levels: FAN finished batches become one folder of merged
rows, FAN such folders one of the next level, and so on. What has been folded
stands in a manifest, a small file per version that is written aside and renamed:
until the rename readers see the old folders, after it the new one, and a fold
that dies before it leaves a folder that nobody reads. So n batches are some
``FAN * log(n)`` folders.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trailspark.session import create_json, delete, names_in, read_json

FAN = 8
FOLDS, MANIFEST = "_folds", "_manifest"

Merge = Callable[[DataFrame], DataFrame]


def start_parts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    merge: Merge,
    mode: str = "append",
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    every: str | None = None,
) -> StreamingQuery:
    """Write ``prepare`` of each micro-batch as a part. ``merge`` makes fewer rows of the same
    meaning and columns out of the rows of some parts, with ``batch_id`` if it keeps it. A
    path belongs to one checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        fold(batch.sparkSession, path, merge)

    return start_each(stream, write, checkpoint, mode, every)


def start_each(
    stream: DataFrame, write, checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Handle all files present now, in as many micro-batches as the source asks for, and
    end; or look for files ``every`` so often until stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


# Manifest -------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The newest version: ``folds`` (first and last batch, level, folder), oldest batches first,
    and the folders that it ``retired``."""
    versions = sorted(int(n.removesuffix(".json")) for n in names_in(spark, path, MANIFEST) if n.endswith(".json"))
    if not versions:
        return {"version": 0, "folds": [], "retired": []}
    return read_json(spark, path, MANIFEST, f"{versions[-1]}.json")


def swap_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write the next version. The rename is the moment from which it holds."""
    if not create_json(spark, manifest, path, MANIFEST, f"{manifest['version']}.json"):
        raise RuntimeError(f"another job has folded {path}")


def _batches(spark: SparkSession, path: str, manifest: dict) -> list[int]:
    """Batches that are not folded, in order."""
    last = max((f["last"] for f in manifest["folds"]), default=-1)
    found = [int(n.removeprefix("batch_id=")) for n in names_in(spark, path) if n.startswith("batch_id=")]
    return sorted(b for b in found if b > last)


def _read(spark: SparkSession, path: str, batches: list[int], folds: list[dict]) -> DataFrame:
    parts = []
    if batches:
        folders = [f"{path}/batch_id={b}" for b in batches]
        parts.append(spark.read.option("basePath", path).parquet(*folders))
    if folds:
        parts.append(spark.read.parquet(*[f"{path}/{FOLDS}/{f['folder']}" for f in folds]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All rows written so far. The manifest is read before the folders are listed, and folded
    folders stay until the next fold, so a fold meanwhile does not disturb."""
    manifest = read_manifest(spark, path)
    batches = _batches(spark, path, manifest)
    if not batches and not manifest["folds"]:
        return spark.read.parquet(path)  # Says what is missing.
    return _read(spark, path, batches, manifest["folds"])


def _due(batches: list[int], folds: list[dict]) -> tuple[list[int], list[dict]] | None:
    """The FAN oldest finished batches, or the last FAN folds if they are of one level.

    The newest batch may be run again and is never folded.
    """
    if len(folds) >= FAN and len({f["level"] for f in folds[-FAN:]}) == 1:
        return [], folds[-FAN:]
    if len(batches) > FAN:
        return batches[:FAN], []
    return None


def fold(spark: SparkSession, path: str, merge: Merge) -> None:
    """Fold what is due, step by step; folders that an earlier call folded are deleted first.
    One job at a time may fold a path."""
    manifest, retired = read_manifest(spark, path), None
    while due := _due(_batches(spark, path, manifest), manifest["folds"]):
        batches, folds = due
        if retired is None:
            _clear(spark, path, manifest)
            retired = []
        first = batches[0] if batches else folds[0]["first"]
        last = batches[-1] if batches else folds[-1]["last"]
        level = 1 if batches else folds[0]["level"] + 1
        folder = f"{first}-{last}-{uuid.uuid4().hex}"
        merge(_read(spark, path, batches, folds)).write.parquet(f"{path}/{FOLDS}/{folder}")
        kept = [f for f in manifest["folds"] if f not in folds]
        retired += [f"batch_id={b}" for b in batches] + [f"{FOLDS}/{f['folder']}" for f in folds]
        manifest = {
            "version": manifest["version"] + 1,
            "folds": [*kept, {"first": first, "last": last, "level": level, "folder": folder}],
            "retired": retired,
        }
        swap_manifest(spark, path, manifest)


def _clear(spark: SparkSession, path: str, manifest: dict) -> None:
    """Delete what the manifest's fold retired, what unfinished folds left, and old versions."""
    for name in manifest["retired"]:
        delete(spark, path, name)
    used = {f["folder"] for f in manifest["folds"]}
    for name in set(names_in(spark, path, FOLDS)) - used:
        delete(spark, path, FOLDS, name)
    for name in names_in(spark, path, MANIFEST):
        if name != f"{manifest['version']}.json":
            delete(spark, path, MANIFEST, name)
