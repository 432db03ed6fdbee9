"""Equal-sized shards by sampled splitters, in DataFrame operations only.

Rows are ordered by the hash of their text, so copies lie side by side. A
size-weighted sample of these keys gives quantile boundaries, which cut the
rows into many more ranges than shards. A range that holds more than its
share, such as one with a large group of copies, is subdivided by a hash of
the id. The resulting cells are small; their sizes, added up in order, tell
every row its place on a line from 0 to the sum of all sizes, and equal parts
of that line are the shards.

Sizes differ by no more than the largest document or kept-together group.
A group of equal texts stays together where it is smaller than a
``TOGETHER``-th part of a shard and its range is not subdivided.

Defined cases: null text has size 16 and the checksum of no bytes; an empty
table gives no rows; repeated rows get places of their own; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpen.llm.tables import stored

ROW_BYTES = 16
#: Ranges for each shard, and sampled keys for each range.
RANGES, SAMPLES = 16, 25
#: A group of copies up to this part of a shard is not split at a shard's end.
TOGETHER = 20


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size, checksum and position key: all that the later steps need of a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("place"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Boundaries of ``ranges`` ranges of about equal size.

    A row is drawn with a probability in proportion to its size; the expected
    number drawn is ``ranges * SAMPLES`` at most, whatever the input's size.
    """
    chance = F.pmod(F.xxhash64("doc_id", F.lit("splitter")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(chance < F.col("size") * F.lit(ranges * SAMPLES / max(total, 1)))
    keys = sorted(r.place for r in drawn.select("place").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def range_of(place: Column, boundaries: list[int]) -> Column:
    """How many boundaries are not above ``place``, by two short steps."""
    if not boundaries:
        return F.lit(0)
    step = max(1, int(len(boundaries) ** 0.5))
    blocks = [boundaries[i : i + step] for i in range(0, len(boundaries), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= place))

    longs = [F.array(*map(F.lit, block)).cast("array<bigint>") for block in blocks]
    block = below(F.array(*[F.lit(b[0]) for b in blocks]).cast("array<bigint>"))
    inside = below(F.element_at(F.array(*longs), F.greatest(block, F.lit(1))))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its size, checksum, shard and gapless slot in the shard."""
    rows = stored(measured(docs, key, text), "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    ranges = shards * RANGES
    ranged = rows.withColumn("part", range_of(F.col("place"), splitters(rows, total, ranges)))

    share = F.lit(max(1, total // ranges))
    full = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    pieces = full.select("part", F.when(F.col("bytes") > 2 * share, F.ceil(F.col("bytes") / share)).otherwise(1).alias("pieces"))
    # At most `ranges` rows, and at most three times as many cells.
    cut = ranged.join(F.broadcast(pieces), "part").withColumn(
        "piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0)
    )
    before = W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        cut.groupBy("part", "piece")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            "piece",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        )
    )
    cell = W.partitionBy("part", "piece").orderBy("place", "doc_id", "size")
    group = W.partitionBy("part", "piece", "place")
    placed = (
        cut.join(F.broadcast(cells), ["part", "piece"])
        .withColumn(
            "start",
            F.col("bytes_before") + F.coalesce(F.sum("size").over(cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("index", F.col("rows_before") + F.row_number().over(cell) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_start", F.min("start").over(group))
    )
    small = F.col("group_bytes") * (shards * TOGETHER) <= F.lit(total)
    middle = F.when(small, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("start") + F.col("size"))
    number = F.floor(middle * F.lit(shards) / F.lit(2.0 * max(total, 1)))
    placed = stored(
        placed.select(
            "doc_id", "size", "text_crc32", F.least(number, F.lit(shards - 1)).cast("int").alias("shard"), "index"
        ),
        "places",
    )
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("index") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
