"""Small driver-side files on any file system that Hadoop knows.

A table's state is one small file that is replaced by an atomic rename, as
local disks and HDFS have. Object stores without such a rename are not safe
places for a store.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_temporary: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a local master may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/heronry-shared"


def temporary(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _temporary:
        atexit.register(_clean)
    _temporary.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _temporary:
        with contextlib.suppress(Exception):  # a session may be gone; its cluster's retention removes the folder
            remove(spark, path)


def vanished(error: BaseException) -> bool:
    """Whether ``error`` tells that a file that a plan names is no longer there."""
    return isinstance(error, FileNotFoundError) or any(x in str(error) for x in ("FILE_NOT_EXIST", "PATH_NOT_FOUND", "FileNotFoundException"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a file; FileNotFoundError if there is none."""
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside ``path``, make it durable, and rename over ``path``."""
    jvm, p, fs = _fs(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(staged), context.makeQualified(p), options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that isn't there yet; False if it is."""
    jvm, p, fs = _fs(spark, path)
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):  # perhaps gone again by now
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def rename(spark: SparkSession, path: str, to: str) -> bool:
    jvm, p, fs = _fs(spark, path)
    return fs.exists(p) and fs.rename(p, jvm.org.apache.hadoop.fs.Path(to))


def local(path: str) -> str:
    """A path for Python's own file functions; a ValueError if it isn't on a mounted file system."""
    plain = path[len("file:") :] if path.startswith("file:") else path
    if "://" in plain:
        raise ValueError(f"{path} is not on a mounted file system")
    return "/" + plain.lstrip("/") if path.startswith("file:") else plain


def make_dir(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))
