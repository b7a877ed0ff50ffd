"""Manifests of run folders: committed once for all writers, compared field by field before any work.

A manifest is a JSON document under ``<folder>/manifest``, a file for each version. A version is
created only if it doesn't exist, so of two writers one commits and the other reads that and tries
the next version; the last version holds what all of them ran.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from ..operators.align import DataError

#: Seconds after which a version that was created but not written is given up.
PATIENCE = 10.0


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read(spark: SparkSession, folder: str, version: int) -> dict:
    began = time.time()
    while True:
        text = spark.read.option("wholetext", True).text(f"{folder}/manifest/{version:06d}.json").first()
        try:
            return json.loads(text[0])
        except (TypeError, ValueError):
            if time.time() - began > PATIENCE:
                raise DataError(f"version {version} of the manifest in {folder} was never written") from None
            time.sleep(0.2)


def read_manifest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The last version and its content; 0 and None without one."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return 0, None
    versions = [int(f.getPath().getName()[:6]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")]
    return (max(versions), _read(spark, folder, max(versions))) if versions else (0, None)


def commit_manifest(spark: SparkSession, folder: str, fixed: dict, unioned: dict[str, list] | None = None) -> dict:
    """The manifest after this run: ``fixed`` fields must be those of the folder, ``unioned`` lists grow.

    Raises a DataError that names the first field that differs, before anything is written.
    """
    fixed = json.loads(json.dumps(fixed))
    while True:
        version, old = read_manifest(spark, folder)
        for name in sorted({*fixed, *(old or {}).get("fixed", {})}) if old else ():
            if old["fixed"].get(name) != fixed.get(name):
                raise DataError(f"{folder} belongs to a run with another {name}: {old['fixed'].get(name)!r}, not {fixed.get(name)!r}")
        lists = {k: sorted({*(old or {}).get("lists", {}).get(k, []), *v}) for k, v in (unioned or {}).items()}
        if old and lists == old["lists"]:
            return old
        new = {"fixed": fixed, "lists": lists, "writer": uuid.uuid4().hex}
        fs, path = _files(spark, folder)
        try:
            out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{version + 1:06d}.json"), False)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            continue  # another writer was first
        out.write(json.dumps(new).encode())
        out.close()
        if _read(spark, folder, version + 1)["writer"] == new["writer"]:
            return new
