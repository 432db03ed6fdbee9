"""Lookup joins that survive one key holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices of the rows per shuffle partition; a key larger than one slice is spread.
SLICES_PER_PARTITION = 4


def hot_hashes(counts: DataFrame, key: str, slices: int, n: str = "n") -> DataFrame:
    """(_hot, _salts): hash of every key above one of ``slices`` equal parts of all rows, and how many it fills.

    Fewer than ``slices`` keys can be that frequent, and all their parts together
    are fewer than twice as many, whatever the data.
    """
    counts = counts.where(F.col(key).isNotNull())
    part = F.greatest(counts.agg(F.sum(n)).scalar() / slices, F.lit(1.0))
    salts = F.ceil(F.col(n) / part).cast("int")
    hot = counts.select(F.xxhash64(key).alias("_hot"), salts.alias("_salts")).where(F.col("_salts") > 1)
    return hot.groupBy("_hot").agg(F.max("_salts").alias("_salts"))


def lookup(rows: DataFrame, unique: DataFrame, key: str, row_id: Column, counts: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``unique`` (one row per ``key``).

    ``counts`` holds (key, n). A key with more rows than a slice is spread by
    ``row_id`` over as many join keys as it fills slices, and repeated as often
    on the other side. Counts affect speed, never the result. What is broadcast
    is 12 bytes for at most ``SLICES_PER_PARTITION`` keys per shuffle partition.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = SLICES_PER_PARTITION * partitions
    hot = F.broadcast(hot_hashes(counts, key, slices))
    mine = rows.withColumn("_h", F.xxhash64(key)).join(hot, F.col("_h") == F.col("_hot"), "left")
    # Rows without a key find nothing, wherever they go.
    over = F.when(F.col(key).isNull(), F.lit(slices)).otherwise(F.coalesce("_salts", F.lit(1)))
    mine = mine.withColumn("_salt", F.pmod(F.xxhash64(row_id), over).cast("int")).drop("_h", "_hot", "_salts")

    theirs = unique.withColumn("_h", F.xxhash64(key)).join(hot, F.col("_h") == F.col("_hot"), "left")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    theirs = theirs.withColumn("_salt", F.explode(copies))
    return mine.join(theirs.drop("_h", "_hot", "_salts"), [key, "_salt"], "left").drop("_salt")
