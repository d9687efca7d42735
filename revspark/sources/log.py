"""Commit log of a stored table: what a load wrote counts once the log says so.

A load writes its part files to a folder of its own and then publishes a manifest, the
list of those files, under ``_log/<load>``, by a rename. Readers take the manifests'
files only. A load that failed half way is invisible; one that is run again under the
same name, whether it had failed or not, replaces itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

LOG = "_log"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _read(spark: SparkSession, path: str) -> dict:
    p, fs = _fs(spark, path)
    source = fs.open(p)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def manifests(spark: SparkSession, store: str) -> dict[str, dict]:
    """The published loads: name to ``{"folder": ..., "files": [...]}``. One small file each."""
    return {n: _read(spark, f"{store}/{LOG}/{n}") for n in _names(spark, f"{store}/{LOG}") if not n.startswith(".")}


def has_log(spark: SparkSession, store: str) -> bool:
    p, fs = _fs(spark, f"{store}/{LOG}")
    return fs.exists(p)


def committed_files(spark: SparkSession, store: str) -> list[str]:
    """Part files of all published loads; of a store without a log, the store itself."""
    if not has_log(spark, store):
        return [store]
    return [f"{store}/{m['folder']}/{f}" for m in manifests(spark, store).values() for f in m["files"]]


def commit(spark: SparkSession, store: str, load: str, write: Callable[[str], None]) -> None:
    """Run ``write(folder)`` and publish what it wrote as ``load``, in place of an earlier run of it."""
    if not load or load.startswith((".", "_")) or "/" in load:
        raise ValueError(f"no name for a load: {load!r}")
    old = manifests(spark, store).get(load)
    folder = f"load-{load}-{uuid.uuid4().hex[:12]}"
    write(f"{store}/{folder}")
    files = [n for n in _names(spark, f"{store}/{folder}") if not n.startswith(("_", "."))]
    draft, fs = _fs(spark, f"{store}/{LOG}/.{folder}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"folder": folder, "files": files}).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    final, _ = _fs(spark, f"{store}/{LOG}/{load}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    if old:  # no manifest names it any more
        p, fs = _fs(spark, f"{store}/{old['folder']}")
        fs.delete(p, True)
