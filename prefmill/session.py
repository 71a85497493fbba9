"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Settings that hold from a laptop to a cluster; sizes are left to the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing and model calls make much of few bytes, so small parts are not merged into one.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    # Whole documents go to the Python workers, so batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

_own_dirs: dict[str, str] = {}
_to_clear: set[str] = set()


def build_session(app: str = "prefmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own. A cluster session is refused without
    it, and with one below this machine's temporary folder: such data would be lost with the machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    local = context.master.startswith("local")
    if named:
        if not local and _below_temp(named):
            raise ValueError(f"spark.checkpoint.dir names {named}, a folder of one machine")
        return named
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="prefmill-")
        context.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def _below_temp(path: str) -> bool:
    kind, _, place = path.rpartition(":")
    own = os.path.normpath("/" + place.lstrip("/")) + "/"
    return kind in ("", "file") and any(own.startswith(f"{t.rstrip('/')}/") for t in ("/tmp", "/var/tmp", tempfile.gettempdir()))


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/prefmill/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a part of it that is this application's own."""
    root = _scratch_root(spark)
    if root not in _to_clear:
        _to_clear.add(root)
        # What the application left there goes when Python ends; the gateway outlives the session.
        atexit.register(_delete, spark.sparkContext._jvm, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once nothing reads them any more."""
    _delete(spark.sparkContext._jvm, _scratch_root(spark))


def _delete(jvm, path: str) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Py4JError, OSError):  # at exit the gateway may be gone; the folder then stays
        place.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(place, True)


def found_at(spark: SparkSession, path: str) -> list[str]:
    """The full names of what lies at a path (or matches a pattern), in whatever store Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in system.globStatus(place) or []]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or one that matches a pattern) is there."""
    return bool(found_at(spark, path))


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: its plan is cut, and its work done once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
