"""What the operators of this subpackage share: reading, shared storage, Arrow maps and bounded caches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words as the contracts define them: runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"


#: Bytes of a batch that goes to a Python worker, whatever the number and length of its texts.
BATCH_BYTES = 1 << 20


#: Of a row group that a task gathers before it writes.
ROW_GROUP_BYTES = 32 << 20


def lean(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes: by rows alone, a batch of long texts would take any memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where the session names none and runs in one process."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and any executor can be lost."""
    spark = lean(df.sparkSession)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` gave and that nothing will read again; others are left alone.

    The driver then collects its garbage: Spark removes the shuffle files of steps whose plans are gone.
    """
    for df in tables:
        sc = df.sparkSession.sparkContext
        if path := getattr(df, "stored_path", None):
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        sc._jvm.System.gc()


#: Rows of a few numbers each, some 20 MB, that are broadcast; larger tables are shuffled.
BROADCAST_ROWS = 400_000


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table``, a stored one of a few numeric columns, to be broadcast if its rows (or the bound given) are few enough."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


#: In a Python worker: what drops each operator's tables, and the operator that ran last.
_DROPS: dict[str, Callable[[], None]] = {}
_last = [""]


def droppable(owner: str, drop: Callable[[], None]) -> None:
    """Names what drops the tables that ``owner``, a module, keeps in a worker between tasks."""
    _DROPS[owner] = drop


def trim() -> None:
    """Gives memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if free := getattr(ctypes.CDLL(None), "malloc_trim", None):
        free(0)


def occupy(owner: str) -> None:
    """Called by tasks of ``owner``, a module: workers outlive stages, so the tables of other operators go before its own come."""
    if _last[0] == owner:
        return
    _last[0] = owner
    for other, drop in _DROPS.items():
        if other != owner:
            drop()
    gc.collect()
    trim()


def arrow_map(df: DataFrame, fn: Callable[..., dict], schema: str, *columns: str, pieces: Callable[[Iterator], Iterator] = iter) -> DataFrame:
    """``fn`` over batches of the named columns; it takes Arrow arrays and returns the columns of ``schema``.

    Only the named columns leave the JVM. Batches are bounded by Spark's Arrow settings, and cut further by ``pieces``,
    so memory does not grow with a partition.
    """
    lean(df.sparkSession)
    frame = df.select(*columns)
    target = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occupy(fn.__module__)
        for batch in pieces(batches):
            made = fn(*batch.columns)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) for x, f in zip(made.values(), out, strict=True)], schema=out)
        trim()

    return frame.mapInArrow(run, target)


class Cache(dict):
    """A bounded memo in two generations: at most 2 * ``size`` entries, the least recently filled half goes first.

    Keys longer than ``longest``, if given, are not kept, so that entries bound bytes as well.
    """

    def __init__(self, fn: Callable, size: int, longest: int | None = None):
        super().__init__()
        self.fn, self.size, self.longest, self.old = fn, size, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.fn(key)
        old = self.old
        value = old[key] if key in old else self.fn(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def fold(column) -> object:
    """crc32 of the id as text: the folds of the contracts are its remainders."""
    return F.crc32(column.cast("string").cast("binary"))
