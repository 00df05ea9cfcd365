"""Small files on any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """The path as listings have it."""
    p, fs = _fs(spark, path)
    return fs.makeQualified(p).toString()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file in one step, where the file system can rename."""
    p, fs = _fs(spark, path)
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    part, _ = _fs(spark, f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't write {path}")


def glob(spark: SparkSession, directory: str, suffix: str = "", recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a directory whose names end so, sorted by path."""
    p, fs = _fs(spark, directory)
    if not fs.exists(p):
        raise FileNotFoundError(directory)
    found, it = [], fs.listFiles(p, recursive)
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(suffix):
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def size(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength()
