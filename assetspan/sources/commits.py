"""Numbered commits: what is put under a name is put whole, by one writer only, and is never changed.

Readers take the highest number; writers that meet at a number see who was first, and the others go on from there.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in a file system that this process shares, or None for another store."""
    fs, p = file_system(spark, path)
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename in one step, unless there is a target; False if there is."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(file_system(spark, source)[0].getUri(), spark._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(file_system(spark, source)[1], file_system(spark, target)[1], options)
    except Exception as error:
        if "FileAlreadyExists" in str(error) or file_system(spark, target)[0].exists(file_system(spark, target)[1]):
            return False
        raise
    return True


def put_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Rename the folder `source`; where there is a target it is left as it is and the source is removed."""
    here, there = _local(spark, source), _local(spark, target)
    if here and there:
        try:
            os.rename(here, there)  # fails in one step where the target is a folder that holds something
            return True
        except OSError:
            if not os.path.isdir(there):
                raise
            moved = False
    else:
        moved = _move(spark, source, target)
    if not moved:
        fs, p = file_system(spark, source)
        fs.delete(p, True)
    return moved


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file at path unless there is one: it is written beside it, and then named in one step.  True for the writer who named it."""
    draft = f"{path.rpartition('/')[0]}/_draft.{uuid.uuid4().hex}"
    fs, p = file_system(spark, draft)
    fs.mkdirs(p.getParent())
    here, there = _local(spark, draft), _local(spark, path)
    if here and there:
        with open(here, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    moved = _move(spark, draft, path)
    if not moved:
        fs.delete(p, False)
    return moved


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the commits `name` in a folder."""
    fs, p = file_system(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split(".")[1]) for n in found if n.startswith(f"{name}.") and n.endswith(".json"))


def commit_file(path: str, name: str, number: int) -> str:
    return f"{path}/{name}.{number:012d}.json"


def commit(spark: SparkSession, path: str, name: str, text: str) -> int:
    """Put the text under the next free number, however many writers try, and give that number."""
    number = max(numbers(spark, path, name), default=0) + 1
    while not put_text(spark, commit_file(path, name, number), text):
        number += 1
    return number


def latest(spark: SparkSession, path: str, name: str) -> tuple[int, dict | None]:
    """The highest number and its record, which is one JSON object; (0, None) where there is none."""
    number = max(numbers(spark, path, name), default=0)
    if not number:
        return 0, None
    text = spark.read.text(commit_file(path, name, number), wholetext=True).first()[0]
    return number, json.loads(text)
