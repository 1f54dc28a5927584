"""Words, shared folders and small DataFrame helpers used by the operators of this subpackage."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import at, discard, shared_folder  # noqa: F401

#: The six ASCII white-space characters that part words, and the class of everything else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Native array of the words of a text; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+", -1))


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    df.write.option("compression", "zstd").parquet(path := fresh(df.sparkSession, name))
    return at(df.sparkSession.read.schema(df.schema).parquet(path), path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a file in the shared folder, in an executor or the driver."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


class Draft:
    """A file that gets its final name when it is closed: a lost or repeated task leaves no half file under that name."""

    def __init__(self, uri: str):
        self.store, self.path = filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft, self.size = f"{self.path}.{uuid.uuid4().hex}.draft", 0
        self.out = self.store.open_output_stream(self.draft)

    def write(self, chunk: bytes) -> tuple[int, int]:
        """(offset, size) of what was written."""
        self.out.write(chunk)
        self.size += len(chunk)
        return self.size - len(chunk), len(chunk)

    def close(self) -> int:
        self.out.close()
        self.store.move(self.draft, self.path)
        return self.size


def put_file(uri: str, chunks) -> int:
    """Write a file whole or not at all."""
    out = Draft(uri)
    for chunk in chunks:
        out.write(chunk)
    return out.close()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: where the session still has Spark's own default of 10,000 rows a batch, Arrow carries so many at a
    time, which bounds the buffers of executors and workers. It is a setting of the session, and stays, for plans are run
    after the operator has returned; any other value is the caller's and is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def tidy(work):
    """For functions of mapInArrow: workers are used again by other stages, so what a task held goes back at its end."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
