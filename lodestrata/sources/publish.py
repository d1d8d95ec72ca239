"""Outputs of a run, published whole or not at all.

A writer claims the folder by a file that only one can create, writes all tables aside, then
a manifest (configuration hash, row counts, schemas) and the list of files with their
hashes, and renames the whole to its place. What is published is never written to again. A
claim is renewed at every table; one that is older than its lease belonged to a writer that
died, and the next one takes it over and clears away what it left.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.hashing import content_hashes
from lodestrata.sources.panels import canonical_json

#: Seconds after which a claim that was not renewed is void.
LEASE = 3600


class InUse(RuntimeError):
    """The folder is published already, or another writer has claimed it."""


class _Folder:
    """What the protocol needs of Hadoop's file system, for any store Spark writes to."""

    def __init__(self, spark: SparkSession, target: str):
        jvm = spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def create(self, p: str, text: str) -> bool:
        """Write a file that must not be there; false if it is."""
        try:
            out = self.fs.create(self.path(p), False)
        except Exception as e:
            if "exist" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        data = bytes(stream.readAllBytes())
        stream.close()
        return data.decode()

    def age(self, p: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(p)).getModificationTime() / 1000

    def renew(self, p: str) -> None:
        self.fs.setTimes(self.path(p), int(time.time() * 1000), -1)

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def _claimed(folder: _Folder, claim: str, staging: str, lease: float) -> None:
    if folder.create(claim, staging):
        return
    if folder.age(claim) <= lease:
        raise InUse(f"{claim}: another writer is at work")
    left = folder.text(claim)
    dead = f"{claim}.{uuid.uuid4().hex}"
    if not folder.rename(claim, dead) or not folder.create(claim, staging):  # one taker gets it
        raise InUse(f"{claim}: another writer took it over")
    folder.remove(left)
    folder.remove(dead)


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str, config_sha256: str, lease: float = LEASE) -> dict:
    """Write the tables under target in one step and return the manifest."""
    target = target.rstrip("/")
    folder, claim, staging = _Folder(spark, target), f"{target}.claim", f"{target}.staging-{uuid.uuid4().hex}"
    if folder.exists(target):
        raise InUse(f"{target}: published already")
    _claimed(folder, claim, staging, lease)
    try:
        counts, schemas = {}, {}
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            counts[name] = spark.read.schema(df.schema).parquet(f"{staging}/{name}").count()
            schemas[name] = df.schema.simpleString()
            folder.renew(claim)
        content_hashes(spark, staging).selectExpr(f"substring(path, instr(path, '{staging.rsplit('/', 1)[1]}') + {len(staging.rsplit('/', 1)[1]) + 1}) AS file", "bytes", "sha256").write.parquet(f"{staging}/_files")
        known = {"config_sha256": config_sha256, "counts": counts, "schemas": schemas, "spark": spark.version}
        folder.create(f"{staging}/_manifest.json", canonical_json(known))
        if not folder.exists(claim) or folder.text(claim) != staging:
            raise InUse(f"{claim}: the claim ran out")
        if folder.exists(target) or not folder.rename(staging, target):
            raise InUse(f"{target}: published already")
        return known
    finally:
        folder.remove(staging)
        if folder.exists(claim) and folder.text(claim) == staging:
            folder.remove(claim)


def published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A published table, refused unless it has the rows its manifest says."""
    target = target.rstrip("/")
    known = json.loads(_Folder(spark, target).text(f"{target}/_manifest.json"))
    df = spark.read.parquet(f"{target}/{name}")
    if df.count() != known["counts"][name]:
        raise ValueError(f"{target}/{name} is not what was published")
    return df


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """file, listed, found: published files whose hash is not the listed one, or that are
    missing or too many."""
    target = target.rstrip("/")
    listed = spark.read.parquet(f"{target}/_files").selectExpr("file", "sha256 AS listed")
    last = target.rsplit("/", 1)[1]
    found = content_hashes(spark, target).selectExpr(f"substring(path, instr(path, '/{last}/') + {len(last) + 2}) AS file", "sha256 AS found")
    return listed.join(found, "file", "full").where("listed IS NULL OR found IS NULL OR listed <> found")
