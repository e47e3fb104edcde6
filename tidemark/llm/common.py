"""Shared plumbing of the training-data operators: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch, and the bytes of those that a function gets at once (or one row, if that is longer).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Shares by hash among which a bounded sample's threshold is found.
PARTS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, so that long texts do not fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where it is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")  # one machine: its folder is shared
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet below the shared folder (or to path, there) and read it again: the lineage ends here."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system: workers and the driver live on between stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


#: What this worker keeps from task to task, and the keys that the task now running asked for.
KEPT: dict = {}
ASKED: set = set()


def kept(key, make: Callable):
    """make()'s object, which this worker keeps for later tasks that ask for it."""
    ASKED.add(key)
    if key not in KEPT:
        KEPT[key] = make()
    return KEPT[key]


def begun(make: Callable[[], Callable]) -> Callable:
    """The task's function. What make() did not ask for is let go: a worker that goes on to another stage holds that stage's objects only."""
    ASKED.clear()
    fn = make()
    if KEPT.keys() - ASKED:
        for key in KEPT.keys() - ASKED:
            del KEPT[key]
        trim()
    return fn


def trim_executors(spark: SparkSession) -> None:
    """A collection in each executor: a heap that shuffles made grow is given back before Python workers need the room. No data are read."""
    tasks = spark.sparkContext.defaultParallelism  # as many as run at once, so each executor gets its share of them
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def forget(df: DataFrame) -> None:
    """Remove a table that stored() wrote."""
    spark, path = df.sparkSession, getattr(df, "_stored_at", None)
    if path:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of BATCH_BYTES or so: one that is longer is halved, down to single rows."""
    if batch.num_rows > 1 and batch.get_total_buffer_size() > BATCH_BYTES and batch.nbytes > BATCH_BYTES:
        half = batch.num_rows // 2
        yield from parts_of(batch.slice(0, half))
        yield from parts_of(batch.slice(half))
    else:
        yield batch


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """mapInArrow with one function for a task: make() builds it (dictionaries and the like) when the task begins."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = begun(make)
        for batch in batches:
            for part in parts_of(batch):
                out = fn(part)
                if out is not None:
                    yield out
        del fn
        trim()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id, modulus: int, rest: int = 2):
    """crc32(doc_id as text) mod modulus is rest."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest, F.lit(False))


def arrow_filter(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Keep the rows for which the task's function says so; columns stay as they are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = begun(make)
        for batch in batches:
            for part in parts_of(batch):
                yield part.filter(pa.array(fn(part), pa.bool_()))
        del fn
        trim()

    return df.mapInArrow(run, df.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_labelled: int, training=None) -> DataFrame:
    """doc_id, text, label of at most max_labelled labelled documents, those with the smallest hashes of doc_id.

    The threshold on the hash comes from counts (of all rows, then of PARTS shares of the rows under a first,
    wide threshold), so nothing is sorted and the sample, which is broadcast to the documents, has at most
    max_labelled rows whatever the tables' size. All labels are taken where they are fewer. Where a doc_id has
    several texts, the first in order counts, so that repeated documents do not make the sample larger.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    if training is not None:
        rows = rows.filter(training(F.col("doc_id")))
    rows = rows.distinct()
    n = rows.count()
    if n > 4 * max_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < int((1 << 40) * 4 * max_labelled / n))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    end, total = 0, 0
    while end < PARTS and total + counts.get(end, 0) <= max_labelled:
        total += counts.get(end, 0)
        end += 1
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows.filter(part < end)), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
