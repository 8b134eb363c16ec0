"""Helpers that the operators share: shared-folder tables, skew-safe joins, shipping."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import session

#: Groups holding at least 1/HOT_SHARE of all rows are "hot"; there are at most
#: HOT_SHARE of them, which is the proven bound of every broadcast of hot groups.
HOT_SHARE = 512


#: Arrow batches for Python workers: rows and bytes at most, where the session names none.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> None:
    """Make the session ready for Python tasks: the package is sent, batches are small."""
    session.ship(spark)
    for name, value in BATCH.items():
        if spark.conf.get(name, "1") == "1":
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only where the session names none, as in tests, is a local one made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="gristmill-shared-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends here.

    A lost executor then costs no recomputation of what came before, and later
    steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released() -> None:
    """Hand freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def roomy(mb: int = 64) -> None:
    """Let this worker keep up to `mb` of freed memory, so that arrays made again and again are not mapped anew."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, mb << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, mb << 20)  # M_TRIM_THRESHOLD


def tidy(run: Callable) -> Callable:
    """A Python task that hands freed memory back when it ends; workers outlive tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        released()

    return wrapped


def null_low(col: Column) -> Column:
    """Order key of an id in which null comes before every number."""
    return F.struct(col.isNotNull(), col)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with one row per `key` in `groups`, without a task for a hot key.

    Keys of `groups` with `size` >= total/HOT_SHARE are broadcast (at most HOT_SHARE
    rows, since sizes sum to `total` at most); all other keys are joined by a
    shuffle in which no key holds more than that share.  `how`: inner or left.
    """
    limit = max(2, total // HOT_SHARE)
    hot = groups.filter(F.col(size) >= limit)
    cold = groups.filter(F.col(size) < limit)
    by_hot = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return by_hot.unionByName(rest)


#: Cells of a Bloom table: at most MAX_CELLS, so its bitmaps are at most 16 MB.
MAX_CELLS = 1 << 27
#: Cells of one bitmap row, fixed by Spark's bitmap functions.
BITMAP = 32768


def cells_for(rows: int) -> int:
    """About 16 cells a row, a power of two, up to MAX_CELLS."""
    cells = 1 << 16
    while cells < min(16 * rows, MAX_CELLS):
        cells *= 2
    return cells


def bitmaps(cells: DataFrame, *by: str) -> DataFrame:
    """Bitmap rows (`by`, bucket, bits) of a column `cell`."""
    place = cells.select(*by, F.expr(f"cast(cell as bigint) div {BITMAP}").alias("bucket"), (F.col("cell") % BITMAP).alias("bit"))
    return place.groupBy(*by, "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def hit(df: DataFrame, cell: Column, bits: DataFrame, name: str) -> DataFrame:
    """`df` with boolean `name`: whether the bit of `cell` is set in the broadcast bitmaps."""
    own = F.broadcast(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    out = df.withColumn("__cell", cell).withColumn("__bucket", F.expr(f"__cell div {BITMAP}")).join(own, "__bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__cell % {BITMAP}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    out = out.withColumn("__byte", byte).withColumn(name, F.coalesce(F.expr("shiftright(__byte, cast(__cell % 8 as int))").bitwiseAND(1) == 1, F.lit(False)))
    return out.drop("__byte", "__cell", "__bucket", "__bits")


def likely(df: DataFrame, key: Column, wanted: DataFrame, rows: int) -> DataFrame:
    """Rows of `df` whose `key` may be among the one column of `wanted` (a Bloom table).

    None that is wanted is lost; others mostly go before the shuffle that joins them.
    """
    cells = cells_for(rows)
    cell = lambda c: F.xxhash64(c).bitwiseAND(cells - 1)
    bits = stored(bitmaps(wanted.select(cell(F.col(wanted.columns[0])).alias("cell"))), "bloom")
    return hit(df, cell(key), bits, "__likely").filter("__likely").drop("__likely")
