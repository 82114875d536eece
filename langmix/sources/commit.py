"""Small files that make a write visible: manifests, written last and whole.

A manifest goes to a new name next to its place and is then renamed, so a
reader sees all of it or nothing. ``create`` never replaces one that exists:
of two writers that claim the same name, one gets an error."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest, or None without one."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, content: dict, create: bool = False) -> None:
    """Make the manifest visible at once; with ``create`` only where none is."""
    fs, p, jvm = _fs(spark, path)
    if create and fs.exists(p):
        raise FileExistsError(path)
    data = json.dumps(content, sort_keys=True).encode()
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{hashlib.sha256(data).hexdigest()[:12]}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not create and fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):   # refuses a name that another writer took meanwhile
        fs.delete(part, False)
        raise FileExistsError(path)


def drop_manifest(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, False)


def manifests(spark: SparkSession, folder: str) -> list[dict]:
    """All manifests of a folder, by name."""
    fs, p, _ = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    return [read_manifest(spark, n) for n in names]


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of every data file under a path, by path: what a cache was made from. Names that
    Spark skips (``_`` and ``.`` first) are left out."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return []
    root = fs.getFileStatus(p).getPath().toString()
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        name = s.getPath().toString()
        if not any(part[:1] in ("_", ".") for part in name[len(root):].split("/")):
            out.append((name, s.getLen(), s.getModificationTime()))
    return sorted(out)


def fingerprint(*parts) -> str:
    """Digest of plain values (lists, dicts, numbers, text)."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
