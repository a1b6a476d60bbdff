"""What the operators share: tables in the cluster's shared folder, Arrow mapping, checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; str.split() without arguments would also cut at Unicode spaces.
WORD_GAPS = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where none is set (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/folio/{label}-{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files as it ends; else they stay on the executors' disks until the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a batch that the JVM and a worker each hold whole.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost no more than their own tasks."""
    spark = df.sparkSession
    path = new_path(spark, label)
    ours = {CLEAN_UP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    kept = {k: spark.conf.get(k, "false" if k == CLEAN_UP else "10000") for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written(); only for tables no later result reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow, after which its task gives freed memory back to the system: workers live on from stage to stage, and what they keep adds up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def arrow_map(df: DataFrame, schema: str, each: Callable[[list[list]], list], state: Callable[[], object] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Map df batch by batch. each(columns[, state]) gets the columns as lists and returns the new columns.

    The columns named in carry are not given to each, unless they are also among the others by another name: they
    follow its columns as they are, so each must return a row per row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    names = df.columns
    given = [i for i, n in enumerate(names) if n not in carry]
    along = [names.index(n) for n in carry]
    kinds = StructType([*StructType.fromDDL(schema).fields, *(StructField(n, df.schema[n].dataType) for n in carry)])
    out = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state() if state else None
        for b in batches:
            # a record batch is cut so that texts and what is made of them stay small in memory
            step = max(1, int(b.num_rows * STEP_BYTES / max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                cols = [part.column(k).to_pylist() for k in given]
                made = each(cols, held) if state else each(cols)
                if made is not None:
                    made = [*made, *(part.column(k).cast(out.field(n).type) for k, n in zip(along, carry))]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, out)], schema=out)

    return df.mapInArrow(given_back(run), kinds)


#: Bytes of a record batch handled at once.
STEP_BYTES = 4_000_000


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of doc_id as text leaves the remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id and text of docs, with further columns to carry along under names that clash with none."""
    named = tuple(f"carried_{n}" for n in carry)
    return docs.select("doc_id", "text", *[F.col(f"`{n}`").alias(m) for n, m in zip(carry, named)]), named


def flat_sum(df: DataFrame, fan: int = 32):
    """Sum binary columns of float64 arrays over all rows in two rounds; returns a numpy array. df: part int, data binary."""
    import numpy as np

    def add(batches):
        total, last = {}, None
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(x)
                total[k] = total[k] + v if k in total else v.copy()
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["part", "data"])

    once = df.selectExpr(f"cast(part % {fan} as int) part", "data").repartition(fan, "part").mapInArrow(add, "part int, data binary")
    rows = once.collect()
    total = None
    for r in rows:
        v = np.frombuffer(r.data)
        total = v.copy() if total is None else total + v
    return total
