"""Paths in the folder that driver and executors share, and what Hadoop's file systems tell of them."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if driver and
    executors are one process (tests); a cluster has to name a folder that all its machines see."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    files, place = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file; an error if it is there already. One call, so readers see it or not."""
    files, place = _at(spark, path)
    files.create(place, False).close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path and all below it. A path that is not there is no error."""
    files, place = _at(spark, path)
    files.delete(place, True)


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a path was written, by the file system's and this machine's clocks, or nothing if it is
    not there."""
    files, place = _at(spark, path)
    try:
        return time.time() - files.getFileStatus(place).getModificationTime() / 1000
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception.getClass().getName()):
            return None
        raise


def renew(spark: SparkSession, path: str) -> None:
    """Set a file's time to now."""
    files, place = _at(spark, path)
    files.setTimes(place, int(time.time() * 1000), -1)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file with its content at once, unless there is one of its name; true if it was created.
    The content is written aside and then renamed, which a file system refuses if the name is taken;
    of two who publish one name, one is told false."""
    files, place = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(place), options)
    except Py4JJavaError as e:
        files.delete(aside, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def make_dir(spark: SparkSession, path: str) -> None:
    """A folder, if it is not there."""
    files, place = _at(spark, path)
    files.mkdirs(place)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file; one that is gone has been moved before."""
    files, place = _at(spark, source)
    if files.exists(place) and not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: the names, sizes and times of all files below
    the path, however deep."""
    files, place = _at(spark, path)
    seen = []
    for top in files.globStatus(place) or []:
        if not top.isDirectory():
            seen.append(top)
            continue
        below = files.listFiles(top.getPath(), True)
        while below.hasNext():
            seen.append(below.next())
    return f"{place} " + " ".join(sorted(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}" for x in seen))
