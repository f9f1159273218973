"""Shared plumbing of the training-data operators: scratch tables, Arrow batch maps, bounded caches.

Nothing here holds rows on the driver.  Intermediate results that more than one job reads are
written as Parquet into the folder the cluster names in ``spark.checkpoint.dir``; such a table
survives the loss of any executor, and reading it cuts the lineage.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as each job has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return the written table (same schema, short lineage)."""
        with _released_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application now, once nothing that reads them is left to run; otherwise
    they go when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so clashing extra columns never reach an operator."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    return schema, to_arrow_schema(schema)


def slices(batches: Iterable[pa.RecordBatch], text_at: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so that a batch of long texts stays small in Python."""
    for batch in batches:
        rows = batch.num_rows
        if batch.nbytes <= most or rows <= 1:
            if rows:
                yield batch
            continue
        offsets = batch.column(text_at)
        sizes = pc.binary_length(offsets).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            total += n or 0
            if total >= most:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < rows:
            yield batch.slice(start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` runs once per task and returns a function from a slice to output columns."""
    schema, arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in slices(batches):
            out = work(piece)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict that computes a missing value and forgets everything once it holds ``most`` keys.

    Word frequencies are steep, so after it is emptied the common words are back within one batch.
    """

    def __init__(self, compute: Callable, most: int = 400_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.compute(key)
        if len(key) <= 256:
            self[key] = value
        return value


_per_process: dict = {}


def per_process(key, build: Callable):
    """A model or cache that a Python worker keeps from task to task."""
    if key not in _per_process:
        _per_process[key] = build()
    return _per_process[key]
