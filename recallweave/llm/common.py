"""Session helpers of the corpus operators: tables, shared scratch space, and what is learned on the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, unless the session sets them: texts can be long, and a batch is held by both the
#: JVM and a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, where it doesn't set their size itself."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset: a temporary folder on a local master
    (as in tests), the warehouse on a cluster; never a machine-local folder there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        own = tempfile.mkdtemp(prefix="recallweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table, and bytes of texts, that one task writes where their number is known beforehand.
ROWS_A_FILE, BYTES_A_FILE = 20_000, 8 << 20


def in_files(df: DataFrame, rows: int | None, each: int = ROWS_A_FILE) -> DataFrame:
    """df, its last stage with no more tasks (and files) than `rows` of `each` to a task need. Shuffle partitions are as many
    as the largest exchange needs; small results shouldn't be as many small files."""
    return df if rows is None else df.coalesce(max(1, -(-rows // each)))


def settle(df: DataFrame, name: str, rows: int | None = None, each: int = ROWS_A_FILE) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors. `rows`: how many there
    are at most, if that is known (see in_files)."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, name)
    in_files(df, rows, each).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def unit_hash(*columns) -> F.Column:
    """A hash of the columns, uniform in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def crc_residue(key, modulus: int) -> F.Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(modulus))


def one_of_equal(df: DataFrame, *keys: str) -> DataFrame:
    """df with one row for each distinct value of the keys (which name all of its columns). Hashes of the keys are counted first,
    so rows are shuffled only where there are repeated ones; their copies are reduced before they meet."""
    name = "__rw_hash"
    hashed = df.withColumn(name, F.xxhash64(*keys))
    again = hashed.groupBy(name).count().where("count > 1").select(name)
    if not again.limit(1).count():
        return df
    again = settle(again, "again", df.count())
    single = hashed.join(again, name, "left_anti").select(*keys)
    return single.unionByName(hashed.join(again, name, "left_semi").groupBy(*keys).agg(F.count("*")).select(*keys))


#: Bits of a Bloom filter for each key, the most that one has (8 MB, the bound of what is broadcast), and the places that a key marks.
BITS_A_KEY, MOST_BITS, PLACES = 16, 1 << 26, 3


def maybe_in(df: DataFrame, column: str, keys: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """df without most of the rows whose `column` is null or isn't in the same column of `keys` (a written table); rows that are in it all stay.
    A join after it shuffles little more than it keeps. Where the keys are so many that a filter of `most_bits` would let
    most rows pass, df comes back as it is."""
    n = keys.count()
    words = 1 << max(0, (max(1, min(BITS_A_KEY * n, most_bits)) - 1).bit_length() - 6)
    if 64 * words < n:
        return df
    slots = [F.pmod(F.xxhash64(F.col(column), F.lit(place)), F.lit(64 * words)) for place in range(PLACES)]

    def word(slot):
        return F.shiftright(slot, 6).cast("int")

    def bit(slot):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))

    marks = keys.select(F.explode(F.array(*slots)).alias("slot")).select(word(F.col("slot")).alias("word"), bit(F.col("slot")).alias("bits"))
    marks = marks.unionByName(df.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits")))
    marks = settle(marks.groupBy("word").agg(F.bit_or("bits").alias("bits")), "filter", words)
    bits = marks.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()
    known = [F.get(bits, word(slot)).bitwiseAND(bit(slot)) != 0 for slot in slots]
    return df.where(known[0] & known[1] & known[2])


def numbered(df: DataFrame, order: list[F.Column], column: str) -> DataFrame:
    """df with each row's place in the order, from 1. Rows are dealt into ranges and numbered inside each; what comes before a
    range is a sum over one count for each range, so no task holds more than its range. df is read more than once: give a written table."""
    at = "__rw_at"
    sorted_rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    counts = sorted_rows.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, upto = {}, 0
    for r in counts:
        before[r.part] = upto
        upto += r.n
    offsets = df.sparkSession.createDataFrame(list(before.items()), "__rw_part long, __rw_before long")
    placed = sorted_rows.join(F.broadcast(offsets), F.shiftright(at, 33) == F.col("__rw_part"))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("__rw_before") + inside + 1).alias(column))
