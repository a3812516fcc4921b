"""Session-level plumbing: the folder all executors share, and shipping this package to them."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where a local session names none (tests, a laptop) a folder is made and set; on a cluster every
    node would write to a disk of its own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscale-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; what is written there goes when the application ends."""
    _made.append(f"{shared_base(spark)}/folioscale/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


@atexit.register
def _clear() -> None:
    for uri in _made:
        try:
            fs, path = open_folder(uri)
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_dir(path)
        except Exception:  # noqa: BLE001 - the folder may be gone or out of reach by now
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    fs, path = open_folder(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, path)


def get(uri: str) -> bytes | None:
    """A file's bytes; null where there is none."""
    fs, path = open_folder(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return f.read()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application), by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("folioscale", os.path.relpath(full, root)))
    target = f"{scratch(spark, 'package')}/folioscale_pkg.zip"
    put(target, held.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
