"""Numbered commits of a table of files: who writes the next number first has committed, the others look again.

A commit is a small JSON document beside the table's files; its number is taken by one atomic step of the file system. Files that no commit
names are of writers that lost or died, and do not count.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table_or_none

FOLDER = "_commits"
NUMBER = re.compile(r"(\d{12})\.json")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits, ascending."""
    folder, fs = _files(spark, f"{path.rstrip('/')}/{FOLDER}")
    if not fs.exists(folder):
        return []
    found = (NUMBER.fullmatch(s.getPath().getName()) for s in fs.listStatus(folder))
    return sorted(int(m[1]) for m in found if m)


def read(spark: SparkSession, path: str, number: int) -> dict:
    file, fs = _files(spark, f"{path.rstrip('/')}/{FOLDER}/{number:012}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def last(spark: SparkSession, path: str) -> dict | None:
    """The last commit with its ``number``, None if there is none."""
    found = numbers(spark, path)
    return read(spark, path, found[-1]) if found else None


def publish(spark: SparkSession, path: str, number: int, commit: dict) -> bool:
    """Writes a commit under its number; False if another writer has taken it.

    On a local disk the number is taken by a link, elsewhere by a rename, which must not replace a file (HDFS's does not).
    """
    jvm = spark._jvm
    folder, fs = _files(spark, f"{path.rstrip('/')}/{FOLDER}")
    fs.mkdirs(folder)
    draft, final = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f".{uuid.uuid4().hex}", f"{number:012}.json"))
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(commit | {"number": number}, sort_keys=True).encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(final) and fs.rename(draft, final)
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(final), local(draft))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
    finally:
        fs.delete(draft, False)


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all commits of a table whose folders are ``commit=<name>``; None if there is none."""
    table = table_or_none(spark, path) if numbers(spark, path) else None
    if table is None or "commit" not in table.columns:
        return None
    names = spark.read.schema("commit string").json(f"{path.rstrip('/')}/{FOLDER}/*.json").where("commit is not null")
    return table.withColumn("commit", F.col("commit").cast("string")).join(names, "commit", "left_semi")
