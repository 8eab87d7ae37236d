"""What the operators of this package share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from relspan.sources.shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: A side is broadcast only after a count has shown that it has at most so many narrow rows.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Before Python on the executors: send them this package, and bound Arrow batches by bytes, as texts are long.

    The bounds are the same for all operators, so it doesn't matter which of them has planned last when a plan runs.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. lower() is quick and the same on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on keys in which null meets null; the keys come from the left."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__right_{k}"]) for k in keys))
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"__right_{k}" for k in keys))


def packed(docs: DataFrame, own: list[str]) -> DataFrame:
    """The columns ``own``, and all others together as __rest, so that none clashes with a name used on the way."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def unpacked(df: DataFrame, columns: list[str], own: list[str]) -> DataFrame:
    """What packed() took apart, as these columns."""
    return df.select(*(F.col(c) if c in own else F.col(f"__rest.`{c}`").alias(c) for c in columns))


def unused(columns: list[str], name: str) -> str:
    """The name, or one like it that isn't among columns."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if a count shows that it is small; else the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def scan_partitions(df: DataFrame) -> int:
    """Partitions of df's own scan: they follow the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


#: Cuts that one sketch on the driver finds; beyond these every range between them is cut again by an aggregate of its own.
COARSE = 4096


def id_ranges(df: DataFrame, key: str, parts: int, coarse: int = COARSE) -> tuple[DataFrame, int]:
    """Add range_id: rows of equal key share one, and it rises with the key. Null is lowest. The key must be a number.

    The cuts are quantiles of the key alone, which reads one column; the search among them is binary
    and in the JVM. Keys go through double, which is monotone, so near keys may share a range. The driver holds a sketch of bounded size and the
    cuts themselves, 8 bytes a range.
    """
    if not isinstance(df.schema[key].dataType, NumericType):
        raise TypeError(f"{key} is {df.schema[key].dataType.simpleString()}, not a number")
    first = min(parts, coarse)
    cuts = set(df.stat.approxQuantile(key, [i / first for i in range(1, first)], 0.2 / first)) if first > 1 else set()
    if parts > coarse and cuts:
        each = -(-parts // coarse)
        ranged = _with_ranges(df.select(key), key, sorted(cuts))
        within = ranged.groupBy("range_id").agg(F.percentile_approx(F.col(key).cast("double"), [i / each for i in range(1, each)], 20 * each).alias("cuts"))
        cuts |= {x for r in within.select("cuts").collect() for x in r.cuts or ()}
    if not cuts:
        return df.withColumn("range_id", F.lit(0)), 1
    return _with_ranges(df, key, sorted(cuts)), len(cuts) + 1


def _with_ranges(df: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    from pyspark.ml.feature import Bucketizer  # here, as workers that import this module don't need it

    as_double = df.withColumn("__key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__key", outputCol="__range").transform(as_double)
    return cut.withColumn("range_id", F.col("__range").cast("int")).drop("__key", "__range")
