"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.session import new_folder

# The white space that separates words everywhere in this package.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write to the shared folder and read again: later steps start from these files."""
    path = new_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work, after which the worker gives its memory back to the system.

    Workers wait for their next task, often of another operator, beside the JVM.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some systems have it
            if trim:
                trim(0)

    return tidied


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers a thousand at a time: the usual ten thousand long
    texts, several times over while they are worked on, don't fit into a small worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Stored, and sent to every executor if it is at most so many rows of a few numbers;
    a larger one is joined by its key."""
    kept = stored(df, "side")
    return F.broadcast(kept) if kept.count() <= rows else kept


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The names wanted for working columns, with marks in front where the table has such a column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> Column:
    """All columns of the table as one struct, out of the way of working columns."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
