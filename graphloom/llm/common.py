"""What the operators of this subpackage share: scratch tables, size-checked broadcasts, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import graphloom

# functions travel to executors by value: the package need not be installed there
cloudpickle.register_pickle_by_value(graphloom)

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The most rows a side may hold to be broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 5_000


#: Settings while a scratch table is written: batches of bounded bytes to Python, and no shuffle file outlives the write.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: The setting that bounds a batch's bytes, and its default, which is too much where texts go to Python and back: a session that
#: has the default gets the bound of WRITING from its first operator on.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if all runs
    on this machine, an error if not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Lists that gather the scratch folders being made, innermost last.
_gathering: list[list[Scratch]] = []


def written(spark: SparkSession, what: str, make: Callable[[], DataFrame], place: Scratch | None = None) -> DataFrame:
    """What `make` returns, written and read back (in `place`, or a folder of its own); all scratch tables made on the way are deleted."""
    place, made = place or Scratch(spark, what), []
    _gathering.append(made)
    try:
        out = place.keep(make(), what)
    finally:
        _gathering.pop()
        for scratch in made:
            scratch.drop()
    return out


class Scratch:
    """Tables written under the shared folder. Each lives under a new name, so a rerun never reads a half-written one.
    Who returns a frame that reads some of them drops all the others."""

    def __init__(self, spark: SparkSession, what: str):
        if spark.conf.get(BATCH[0]) == BATCH[1]:  # for frames that run later, under the session's settings
            spark.conf.set(BATCH[0], WRITING[BATCH[0]])
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        for made in _gathering[-1:]:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts lineage, and survives lost executors."""
        conf = self.spark.conf
        before = {k: conf.get(k) for k in WRITING}
        try:
            for k, v in WRITING.items():
                conf.set(k, v)
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer read; without names, all of them."""
        jvm = self.spark.sparkContext._jvm
        for place in [self.path(n) for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(place)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows (counted, so df should be a written table), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Two hashes of a text with different seeds, 128 bits together, which stand for the text.
HASHES: tuple[Callable[[Column], Column], ...] = (F.xxhash64, lambda c: F.xxhash64(F.lit(1), c))


def text_key(hashes=HASHES, col: str | Column = "text") -> Column:
    """struct<a, b>: the identity of a row's text (null: the empty one)."""
    return F.struct(hashes[0](text_of(col)).alias("a"), hashes[1](text_of(col)).alias("b"))


def whole_row() -> Column:
    """All columns of a row as the struct row__, so that no name of theirs meets an operator's own."""
    return F.struct("*").alias("row__")


def fraction_crc32(col: Column, mod: int) -> Column:
    """crc32 of a value's text, modulo `mod`; null counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")), F.lit(mod)).cast("int")


def types_of(ddl: str, row: DataFrame | None = None) -> StructType:
    """The columns of a DDL text, after the struct row__ of `row`."""
    from pyspark.sql.types import StructField, _parse_datatype_string

    return StructType(([StructField("row__", row.schema["row__"].dataType)] if row is not None else []) + _parse_datatype_string(ddl).fields)


def record(made: dict, types: pa.Schema) -> pa.RecordBatch:
    """A batch of columns in the order of types; Arrow arrays pass as they are."""
    return pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=f.type) for f in types], names=types.names)


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, TypeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker then gives back what it has freed: it lives on, and would keep the most that it ever took while
    other stages need the executor's memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType, limit: int = 4 << 20) -> DataFrame:
    """mapInArrow with fn from a batch to column dicts, in batches of bounded bytes.

    Long texts make row-counted batches large; they are cut again to about `limit` bytes here.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = types_of(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, limit):
                for made in fn(part):
                    yield record(made, out)

    return df.mapInArrow(releasing(run), schema)


def worker_memo(name: str) -> dict:
    """A dict that outlives the task: Python workers serve many tasks, and functions sent by value have no module of
    their own to keep things in. It must be a cache only, bounded by its user; name tells its contents apart."""
    import sys
    import types

    home = sys.modules.setdefault("graphloom_worker_memo", types.ModuleType("graphloom_worker_memo"))
    return home.__dict__.setdefault(name, {})


def cut(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes each; a longer row stands alone."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= limit:
        if n:
            yield batch
        return
    half = n // 2
    yield from cut(batch.slice(0, half), limit)
    yield from cut(batch.slice(half), limit)
