"""Versions of a stored dataset: what belongs together is written beside it and becomes visible at once.

A version is a small record in root/commits that names what it consists of. It is written under another name and renamed; a
rename onto an existing record fails, so that of two writers of one version only one succeeds. Readers take the newest record;
whatever no record names was left by a writer that failed, and is not seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version meanwhile."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    path = _path(spark, folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def newest(spark: SparkSession, root: str) -> dict | None:
    """The newest record, or None."""
    names = [n for n in listed(spark, f"{root}/commits") if n.endswith(".json") and not n.startswith((".", "_"))]
    return json.loads(spark.read.text(f"{root}/commits/{names[-1]}", wholetext=True).first().value) if names else None  # one small document


def commit(spark: SparkSession, root: str, record: dict) -> None:
    """Make record the version record["version"]; raises Conflict if there is one of that number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, draft = _path(spark, f"{root}/commits/{record['version']:08d}.json"), _path(spark, f"{root}/commits/_{uuid.uuid4().hex}")
    out = final.getFileSystem(conf).create(draft, False)
    out.write(bytearray(json.dumps(record), "utf-8"))
    out.close()
    never_replace = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, never_replace)
    except Exception as e:
        final.getFileSystem(conf).delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{root} has a version {record['version']} already") from e
        raise


def swept(spark: SparkSession, root: str, folder: str, named: set[str]) -> list[str]:
    """Delete what lies in root/folder and isn't named, after writers that failed; gives the names. No writer may be at work."""
    gone = [n for n in listed(spark, f"{root}/{folder}") if n not in named]
    for n in gone:
        path = _path(spark, f"{root}/{folder}/{n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
