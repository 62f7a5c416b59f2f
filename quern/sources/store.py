"""Chunks as a versioned table: each commit replaces or deletes whole documents, all of it or nothing.

A commit writes a segment, the rows and the ids of the documents that it settles,
and then a manifest, which lists the segments of the table in its new version. A
manifest is made only if there is none of that number: of two writers that start
from one version one wins. Readers take one manifest and see that version, whatever is
committed meanwhile. Of a document the rows of the last segment that settles it count.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.catalog import index_errors

#: Refused documents that a message names.
NAMED = 5


class Rejected(ValueError):
    """Chunks that may not be written; nothing has been changed."""


class Conflict(RuntimeError):
    """Another writer has settled the same documents since the version that a commit is based on; nothing has been changed."""


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if it is. Its name appears with its content: readers take no manifest that does not parse."""
    fs, p = _file(spark, path)
    if fs.getUri().getScheme() == "file":  # Hadoop's local files have no exclusive creation
        local = unquote(urlparse(path).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(part, "w") as file:
            file.write(text)
        try:
            os.link(part, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions there are, rising; the table of no commit is version 0, which has no manifest."""
    fs, p = _file(spark, f"{path}/log")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != ".")


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    if not version:
        return {"version": 0, "segments": [], "schema": None}
    return json.loads(spark.read.text(f"{path}/log/{version:020d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The chunks of a version, by default the last; None before the first commit.

    The rows of all segments are read once, and joined with the ids that segments
    after the first settle, which are few next to the table.
    """
    made = manifest(spark, path, (versions(spark, path) or [0])[-1] if version is None else version)
    if not made["segments"]:
        return None
    rows = settled = None
    for place, s in enumerate(made["segments"]):
        now = spark.read.schema(made["schema"]).parquet(f"{path}/data/{s}/rows").withColumn("__at", F.lit(place))
        rows = now if rows is None else rows.union(now)
        if place:
            ids = spark.read.schema(f"doc_id {made['id_type']}").parquet(f"{path}/data/{s}/docs").select("doc_id", F.lit(place).alias("__last"))
            settled = ids if settled is None else settled.union(ids)
    if settled is not None:
        last = settled.groupBy("doc_id").agg(F.max("__last").alias("__last"))
        rows = rows.join(last, "doc_id", "left").where("__last is null or __at >= __last").select(*rows.columns)
    return rows.drop("__at")


def commit(chunks: DataFrame, path: str, dims: int | None = None, deleted: DataFrame | None = None, base: int | None = None, by: str = "kb_id") -> int:
    """Replace the documents that chunks (doc_id, chunk_id, ...) has, and delete the deleted (doc_id); the new version.

    Chunks are computed once, into a new segment, and the checks read that. With
    dims each chunk needs a vector of so many numbers; otherwise, and where a
    doc_id is null, the commit is Rejected and its segment goes before any version
    has it. base is the version that the writer has seen, by default the last. If others have
    committed since, the commit goes on top of theirs, unless one of them has
    settled a document of its own: that is a Conflict. A document that is in
    both tables is replaced. Twice is the same as once. Rows of one segment lie
    in a folder for each value of `by`, so readers of a tenant read no other.
    """
    spark = chunks.sparkSession
    there = versions(spark, path)
    base = (there or [0])[-1] if base is None else base
    name, id_type = uuid.uuid4().hex, chunks.schema["doc_id"].dataType.simpleString()
    at = f"{path}/data/{name}"
    schema = [f for f in chunks.schema.fields if f.name != by] + [chunks.schema[by]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    chunks.write.partitionBy(by).parquet(f"{at}/rows")
    rows = spark.read.schema(ddl).parquet(f"{at}/rows")
    if rows.where("doc_id is null").limit(1).count():
        _drop(spark, at)
        raise Rejected("a chunk has no doc_id")
    if dims is not None:
        bad = index_errors(rows, dims).orderBy("doc_id")
        if named := bad.limit(NAMED).collect():
            message = f"{bad.count()} documents: " + ", ".join(f"{r.doc_id} {r.error}" for r in named)
            _drop(spark, at)
            raise Rejected(message)
    ids = rows.select("doc_id") if deleted is None else rows.select("doc_id").union(deleted.where("doc_id is not null").select(F.col("doc_id").cast(id_type)))
    ids.distinct().write.parquet(f"{at}/docs")
    mine = spark.read.schema(f"doc_id {id_type}").parquet(f"{at}/docs")
    seen = manifest(spark, path, base)
    while True:
        if seen["schema"] not in (None, ddl):
            _drop(spark, at)
            raise Rejected(f"columns {ddl}, not {seen['schema']}")
        made = {"version": seen["version"] + 1, "segments": [*seen["segments"], name], "schema": ddl, "id_type": id_type}
        if _create(spark, f"{path}/log/{made['version']:020d}.json", json.dumps(made)):
            return made["version"]
        others = manifest(spark, path, seen["version"] + 1)
        new = [s for s in others["segments"] if s not in seen["segments"]]
        if len(others["segments"]) <= len(seen["segments"]) or any(_meet(spark, mine, f"{path}/data/{s}/docs", id_type) for s in new):
            _drop(spark, at)
            raise Conflict(f"version {others['version']} settles the same documents")
        seen = others


def _meet(spark: SparkSession, mine: DataFrame, path: str, id_type: str) -> bool:
    return bool(mine.join(spark.read.schema(f"doc_id {id_type}").parquet(path), "doc_id", "left_semi").limit(1).count())


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def compact(spark: SparkSession, path: str, by: str = "kb_id") -> int:
    """A version of the same rows in one segment; a Conflict if anything was committed meanwhile."""
    base = (versions(spark, path) or [0])[-1]
    seen = manifest(spark, path, base)
    if len(seen["segments"]) < 2:
        return base
    name = uuid.uuid4().hex
    read(spark, path, base).write.partitionBy(by).parquet(f"{path}/data/{name}/rows")
    spark.createDataFrame([], f"doc_id {seen['id_type']}").write.parquet(f"{path}/data/{name}/docs")  # nothing is before it
    if not _create(spark, f"{path}/log/{base + 1:020d}.json", json.dumps(seen | {"version": base + 1, "segments": [name]})):
        _drop(spark, f"{path}/data/{name}")
        raise Conflict("something was committed meanwhile")
    return base + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete segments that none of the last `keep` versions has, and older manifests; the names of the segments that went. No commit may be under way."""
    there = versions(spark, path)
    used = {s for v in there[-keep:] for s in manifest(spark, path, v)["segments"]}
    for v in there[:-keep]:
        _drop(spark, f"{path}/log/{v:020d}.json")
    fs, p = _file(spark, f"{path}/data")
    gone = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() not in used) if fs.exists(p) else []
    for s in gone:
        _drop(spark, f"{path}/data/{s}")
    return gone
