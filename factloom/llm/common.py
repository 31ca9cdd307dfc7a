"""What the corpus operators share: the shared folder, written intermediate tables, words.

Intermediate tables are written as Parquet under the folder that the cluster names in
``spark.checkpoint.dir``; driver and executors both see it, so a lost executor costs a re-read
and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The shared folder. It is set here only for local sessions that name none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="factloom-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_root(spark)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Folders opened by this process, in order; ``scratch`` removes them again.
_OPENED: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the tables that operators wrote within: their results must be consumed by then."""
    mark = len(_OPENED)
    try:
        yield
    finally:
        for path in _OPENED[mark:]:
            drop_folder(spark, path)
        del _OPENED[mark:]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed by ``scratch`` or else when the driver's JVM ends."""
    path = f"{shared_root(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _OPENED.append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


class Stash:
    """Tables written to the shared folder in place of caches and local checkpoints."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write and reread; the rows are computed once and survive any executor."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._factloom_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of this stash that no pending plan reads."""
        path = getattr(df, "_factloom_path", None)
        if path:
            drop_folder(self.spark, path)


def text_of(column: str = "text"):
    """The whole text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: extra columns with clashing names never meet ours."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: fewer texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Hand freed memory back to the system: Python workers live on and share a machine with the JVM."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def range_shards(stash: Stash, sizes: DataFrame, id_col: str, size_col: str, target: int) -> tuple[Callable[[DataFrame, Column], DataFrame], int]:
    """(a function that adds ``shard`` to rows with the id, number of shards): ranges of a long id.

    Bounds are quantiles by bytes and depend on the data only. They come from a histogram over the
    bits of the id whose bins are split 256-fold, round by round, while they hold more than a quarter
    of ``target`` bytes, so clustered and outlying ids make no shard large. Ids whose own rows hold
    more than ``target``, and null ids, which come first, are spread over several shards by a hash
    that the function takes. Collected are the final bins, a few for each shard, 16 bytes a bin.
    Rows meet the bounds in an equi-join on the id's leading bits; Spark broadcasts the bounds if small.
    """
    unsigned = F.expr(f"`{id_col}` ^ {_SIGN}")  # the order of ids is that of these bits
    by_id = stash.put(sizes.where(F.col(id_col).isNotNull()).groupBy(unsigned.alias("u")).agg(F.sum(size_col).alias("size")))
    low, high = by_id.agg(F.min(F.expr(f"u ^ {_SIGN}")), F.max(F.expr(f"u ^ {_SIGN}"))).first()
    null_bytes = sizes.where(F.col(id_col).isNull()).agg(F.sum(size_col)).first()[0]
    for_null = 0 if null_bytes is None else max(1, -(-int(null_bytes) // target))
    top = 0 if low is None else max(0, (low ^ high).bit_length() - 12) if (low < 0) == (high < 0) else 52
    starts, held, rest, shift = [], [], by_id, top
    while True:
        bins = stash.put(rest.groupBy(F.shiftrightunsigned("u", shift).alias("bin")).agg(F.sum("size").alias("size")))
        full = (F.col("size") > target // 4) & F.lit(shift > 0)
        done = bins.where(~full).toArrow()
        starts.append(done.column("bin").to_numpy().astype(np.uint64) << np.uint64(shift))
        held.append(done.column("size").to_numpy())
        if shift == 0 or bins.where(full).isEmpty():
            break
        crowded = bins.where(full).select("bin")
        rest = rest.join(crowded, F.shiftrightunsigned("u", shift) == F.col("bin"), "left_semi")
        shift = max(0, shift - 8)
    start, size = np.concatenate(starts), np.concatenate(held)
    order = np.argsort(start)
    start, size = start[order], size[order]
    bounds, many, filled = [], [], 0
    for u, n in zip(start.tolist(), size.tolist()):
        if not bounds or filled + n > target:
            bounds.append(u)
            many.append(max(1, -(-n // target)))
            filled = 0
        filled += n
    ids = np.array(bounds, np.uint64)
    firsts = for_null + np.cumsum([0, *many])
    # by leading bits: the bounds there, and the last one before
    told = []
    for prefix in np.unique(start >> np.uint64(top)).tolist():
        a = max(0, int(np.searchsorted(ids, np.uint64(prefix << top), side="right")) - 1)
        z = int(np.searchsorted(ids, np.uint64((prefix << top) + (1 << top) - 1), side="right"))
        told.append((prefix - (1 << 64) * (prefix >> 63), [x - (1 << 63) for x in bounds[a:z]], firsts[a:z].tolist(), many[a:z]))
    table = stash.put(sizes.sparkSession.createDataFrame(told, "prefix long, bounds array<long>, firsts array<long>, many array<long>"))
    steps = max((len(x[1]) for x in told), default=1).bit_length()

    def deal(rows: DataFrame, spread: Column) -> DataFrame:
        place = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(0).alias("low"), F.size("bounds").alias("high")),
            lambda s, _: _halve(s, F.col(id_col), F.col("bounds")),
            lambda s: s["low"] + 1,
        )
        own = F.element_at("firsts", place) + F.pmod(spread, F.element_at("many", place))
        shard = F.when(F.col(id_col).isNull(), F.pmod(spread, F.lit(max(1, for_null)))).otherwise(own)
        met = rows.join(table, F.shiftrightunsigned(unsigned, top) == F.col("prefix"), "left")
        return met.select(*rows.columns, shard.alias("shard"))

    return deal, max(1, int(firsts[-1]))


#: Flips the sign bit of a long.
_SIGN = "(-9223372036854775807L - 1L)"


def _halve(s: Column, key: Column, bounds: Column) -> Column:
    """One step of the search for the last bound that is no greater than key."""
    middle = F.shiftright(s["low"] + s["high"], 1)
    open_ = s["high"] - s["low"] > 1
    right = open_ & (F.element_at(bounds, middle + 1) <= key)
    return F.struct(F.when(right, middle).otherwise(s["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(s["high"]).alias("high"))
