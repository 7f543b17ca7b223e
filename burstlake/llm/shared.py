"""Scratch tables in the shared folder, and text helpers that several operators use.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir``: the
table outlives any executor, and a reader needs nothing but the shared folder.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The contract's word separators, space and U+0009 to U+000D. ``bytes.split()`` splits at just these.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set, as in tests."""
    for conf in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if found := conf():
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="burstlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: The tables of runs in each ``scoped`` block, the innermost last.
_OPEN: list = []


@contextlib.contextmanager
def scoped():
    """Deletes the scratch tables of all operators called inside, once the block is left.

    Results are lazy and read such tables: write what is wanted inside.

        with scoped():
            ngram_join(docs).write.parquet(path)
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for scratch in _OPEN.pop():
            scratch.drop()


class Scratch:
    """Tables of one run of an operator, each in a folder below the shared one. They stay until ``scoped`` or ``drop`` deletes them."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"
        for runs in _OPEN[-1:]:
            runs.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back: later stages start from the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, all of the run.

        Spark deletes the shuffle files of finished jobs once the driver's JVM
        has collected their handles, so it's asked to: large runs need the disk.
        """
        for name in names or ("",):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.spark._jvm.System.gc()


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[dict], Iterator[dict] | dict]]) -> DataFrame:
    """``mapInArrow`` for functions over a batch's columns as lists.

    ``make()`` runs once a task and returns a function from {column: list} to
    {column: list}; if that function has ``last``, its result closes the task.
    Batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, each = to_arrow_schema(schema), make()
        for batch in batches:
            if batch.num_rows:
                got = each({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[n], out.field(n).type) for n in names], schema=out)
        if (last := getattr(each, "last", None)) and (got := last()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(got[n], out.field(n).type) for n in names], schema=out)

    return df.mapInArrow(run, schema)


def word_count(text: str) -> "F.Column":
    """Words of a text column, on the JVM; null has none."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def heaviest(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of largest ``n``, ``most`` at most: ties beyond are left out together.

    The limit comes from a histogram with a bounded number of bins (an eighth of
    a power of two each), so nothing is sorted and no task sends its own top rows.
    """
    bin_ = F.floor(F.log2(F.col(n).cast("double")) * 8)
    room, least = most, None
    for r in sorted(counts.where(F.col(n) > 0).groupBy(bin_.alias("bin")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.bin):
        room -= r.k
        if room < 0:
            break
        least = r.bin
    return counts.where(F.lit(False) if least is None else (F.col(n) > 0) & (bin_ >= least))
