"""What the text operators share: tables, words, the shared folder, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and \t \n \v \f \r. On UTF-8
#: bytes that is what ``bytes.split()`` finds, and ``bytes.lower()`` lowers A-Z only.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch; a batch ends when either is reached.
ROWS_PER_BATCH, BYTES_PER_BATCH = 256, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts: one bound for all plans of the
    session, as it is read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder (spark.checkpoint.dir).

    Only where that is unset and Spark runs on this machine alone, as in tests, a
    temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    return text.split()


def with_columns(batch: pa.RecordBatch, keep: Iterable[str], **more: pa.Array) -> pa.RecordBatch:
    arrays = [batch.column(k) for k in keep] + list(more.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *more])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_clash(df: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """df with columns of reserved names renamed; positions stay."""
    clash = {r.lower() for r in reserved}
    names = [fresh(df, f"own_{c}")[0] if c.lower() in clash else c for c in df.columns]
    return df.toDF(*names)


def scan(df: DataFrame, function, schema: str, *columns: str) -> DataFrame:
    """Run function(batch) -> RecordBatch over the named columns, batch by batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.select(*columns).mapInArrow(run, schema)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
