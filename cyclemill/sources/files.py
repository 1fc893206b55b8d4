"""Files of a shared folder that only one of several writers may make."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _made(spark: SparkSession, path: str):
    """As fs_of, in a folder that exists, by the file system that a mount point leads to."""
    fs, p = fs_of(spark, path)
    fs.mkdirs(p.getParent())
    real = spark._jvm.org.apache.hadoop.fs.Path(fs.resolvePath(p.getParent()), p.getName())
    return real.getFileSystem(spark._jsc.hadoopConfiguration()), real


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def _is_local(fs) -> bool:
    return fs.getUri().getScheme() == "file"


def _local(p) -> str:
    return p.toUri().getPath()


def moved(spark: SparkSession, source: str, place: str) -> bool:
    """Rename a folder, unless the place exists (False): of several that rename to one place at once, one gets it.

    A plain rename would put the folder into the one that is there. The file system itself refuses it here: a local one as
    no folder replaces one that isn't empty, others by a rename without overwriting, which a name node settles.
    """
    (fs, src), (_, dst) = _made(spark, source), _made(spark, place)
    if _is_local(fs):
        try:
            os.rename(_local(src), _local(dst))
        except OSError:
            if not os.path.isdir(_local(dst)):
                raise
            return False
        return True
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), spark._jsc.hadoopConfiguration()).rename(src, dst, options)
    except Exception:
        if not fs.exists(dst):
            raise
        return False
    return True


def created(spark: SparkSession, place: str, text: str) -> bool:
    """A file of this text, whole from the moment it is seen, unless the place exists (False)."""
    aside = f"{place}.part-{uuid.uuid4().hex[:8]}"
    (fs, src), (_, dst) = _made(spark, aside), _made(spark, place)
    if _is_local(fs):
        with open(_local(src), "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(_local(src), _local(dst))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(_local(src))
    out = fs.create(src, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if moved(spark, aside, place):
        return True
    fs.delete(src, False)
    return False


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = fs_of(spark, path)
    if _is_local(fs):
        with open(_local(p), encoding="utf-8") as f:
            return f.read()
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def first_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """What a file begins with."""
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = fs_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def deleted(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)
