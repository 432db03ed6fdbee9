"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared among its documents by length: a document of k
binary digits of words gets k times its source's level in copies, two at most,
on average. The level is found from the words of each length class, in the
order in which the classes reach two. The whole part of the copies is given to
all; the fraction p is the inclusion probability of one copy more. Documents
are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)),
and the smallest are taken until the sample has its fixed size, here in words:
the prefix of the order whose words come nearest to what the target still
needs. u comes from a hash of id and text, so reruns agree.

Rows are counted by (source, bucket of odds), with about ``BUCKET_ROWS`` rows in
the buckets near the last document taken, however p differs: odds are scaled so
that documents of the source's mean p lie evenly. Running sums over bucket
totals find the bucket in which the source's sample ends; only that one is put
in order. A document is taken again if it is not beyond the last one: a
comparison, without moving its text.

Defined cases: null text has no words; null source is a source of its own,
last in order; null and repeated ids are told apart by their texts; rows with
equal id, text and source share u and are taken together; a source without
words has target 0 and gives no copies; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpen.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 10_000
_HEX_DIGITS = 13


def source_key(source: str = "source") -> Column:
    """A key that also tells null from every string."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def draw(key: str = "doc_id", text: str = "text") -> Column:
    """A number below 2**52 from id and text; u is this plus a half, over 2**52."""
    parts = [F.coalesce(c, F.lit("n")) for c in (F.col(key).cast("string"), F.md5(F.col(text)))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, _HEX_DIGITS), 16, 10).cast("long")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    """Binary digits of the size: the weight of a document within its source."""
    return F.length(F.bin(size)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source: what it shall give. One row per source goes through one task.

    ``sizes`` has (key, source_size, n). Sources in key order get the weights in
    turn and share ``share`` times all words. No target is above ``most`` times
    the source's size; what is cut off goes to the others by weight. In the
    order of cap over weight the capped sources come first, so one running sum
    finds the level at which the rest is filled.
    """
    null_last = F.when(F.col("key") == "n", 1).otherwise(0)
    place = F.row_number().over(W.orderBy(null_last, "key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sized = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    sized = sized.withColumn("bound", F.col("cap") / F.col("weight"))
    order = W.orderBy("bound", "key")
    every = W.partitionBy()
    earlier = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    here_on = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    whole = F.sum("source_size").over(every) * F.lit(float(share))
    level = (whole - earlier) / here_on
    sized = sized.withColumn("level", level).withColumn("turn", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("turn", "level"))).over(every)
    target = F.least(F.col("cap"), F.col("weight") * first["level"])
    return sized.select("key", "source_size", "n", target.alias("target"))


def expected(classes: DataFrame, most: float) -> DataFrame:
    """Per (key, class): ``whole`` copies for all and the probability ``p`` of one more.

    ``classes`` has (key, class, words, source_size, target). Long classes reach
    ``most`` first, so one running sum finds the level at which the rest is filled.
    """
    order = W.partitionBy("key").orderBy(F.col("class").desc())
    earlier = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    here_on = F.sum(F.col("class") * F.col("words")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    leveled = classes.withColumn("level", F.try_divide(F.col("target") - earlier, here_on.cast("double")))
    first = F.max(F.when(F.col("class") * F.col("level") <= most, F.struct("class", "level"))).over(W.partitionBy("key"))
    level = F.coalesce(first["level"], F.lit(float(most)))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("class") * level)).otherwise(0.0)
    leveled = leveled.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long"))
    return leveled.withColumn("p", F.col("copies") - F.col("whole")).drop("level", "copies")


def odds() -> Column:
    """Random odds over inclusion odds of a row with its ``draw`` and its class's ``p``."""
    u = (F.col("draw") + 0.5) / F.lit(float(1 << 52))
    return F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))


def bucket() -> Column:
    """The place of the odds among the source's buckets; rising with the odds."""
    scaled = odds() * F.col("mean") / (1 - F.col("mean"))
    return F.floor(F.col("buckets") * (1 - 1 / (1 + scaled))).cast("long")


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, size, key, class, draw), and per (key, class) target, copies and where the sample ends."""
    rows = docs.select(
        F.col(key).alias("doc_id"), words(text).alias("size"), source_key(source).alias("key"), draw(key, text).alias("draw")
    )
    rows = stored(rows.withColumn("class", length_class(F.col("size"))), "sizes")
    classes = stored(rows.groupBy("key", "class").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "classes")
    sizes = classes.groupBy("key").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    aims = targets(sizes, weights, share, most).drop("n")
    shared = expected(classes.join(aims, "key"), most)
    own = W.partitionBy("key")
    drawn = F.col("p") > 0
    mass = F.sum(F.when(drawn, F.col("words")).otherwise(0)).over(own)
    shared = shared.withColumn("need", F.sum(F.col("p") * F.col("words")).over(own))
    mean = F.coalesce(F.try_divide(F.col("need"), mass.cast("double")), F.lit(0.5))
    shared = shared.withColumn("mean", F.greatest(F.least(mean, F.lit(1 - 1e-9)), F.lit(1e-9)))
    buckets = F.ceil(F.sum(F.when(drawn, F.col("n")).otherwise(0)).over(own) / BUCKET_ROWS)
    shared = stored(shared.withColumn("buckets", F.greatest(F.lit(1), buckets).cast("long")).drop("words", "n"), "targets")

    ranked = rows.join(shared.where(drawn), ["key", "class"])
    ranked = stored(ranked.select("key", "size", "draw", "need", odds().alias("odds"), bucket().alias("bucket")), "ranked")
    upto = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = ranked.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = totals.where(F.col("before") <= F.col("need")).groupBy("key")
    edge = edge.agg(F.max(F.struct("bucket", "before")).alias("edge")).select("key", "edge.*")
    last = ranked.join(edge, ["key", "bucket"]).groupBy("key", "odds", "draw")
    last = last.agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("before").alias("before"))
    inside = W.partitionBy("key").orderBy("odds", "draw").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    last = last.where(2 * F.col("before") + F.col("words") <= 2 * F.col("need"))
    last = last.groupBy("key").agg(F.max(F.struct("odds", "draw")).alias("last"))
    ends = edge.select("key", F.col("bucket").alias("edge")).join(last, "key", "left")
    return rows, stored(shared.join(ends, "key", "left"), "plan")


def copies() -> Column:
    """Copies of a row that has its class's plan beside it, and its own ``draw``."""
    inside = (bucket() == F.col("edge")) & (F.struct(odds().alias("odds"), F.col("draw")) <= F.col("last"))
    again = (bucket() < F.col("edge")) | F.coalesce(inside, F.lit(False))
    return F.col("whole") + F.when((F.col("p") > 0) & again, 1).otherwise(0)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Per row: its size, its source's size and target, and the words the mix takes of it."""
    rows, chosen = plan(docs, **settings)
    return rows.join(chosen, ["key", "class"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns."""
    _, chosen = plan(docs, key=key, text=text, source=source, **settings)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(
        *columns,
        source_key(source).alias("key"),
        length_class(words(text)).alias("class"),
        draw(key, text).alias("draw"),
    )
    repeated = own.join(chosen, ["key", "class"]).withColumn("copies", copies().cast("int"))
    rows = repeated.select(*at.values(), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return rows.select([F.col(at[c]).alias(c) for c in docs.columns])


def mix_sql(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> str:
    """The same over table ``documents`` for DuckDB, with one window per source."""
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH r AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'n') || ':' || coalesce(md5(text), 'n')), 1, {_HEX_DIGITS}) AS BIGINT) AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM r GROUP BY source),
w AS (
  SELECT *, source_size * {float(most)} AS cap, CASE place % {len(weights)} {cases} END AS weight FROM s),
o AS (
  SELECT *, cap / weight AS bound,
    (sum(source_size) OVER () * {float(share)}
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, place) AS turn
  FROM w),
l AS (SELECT arg_min(level, turn) AS level FROM o WHERE level <= bound),
t AS (
  SELECT o.source, o.source_size, least(o.cap, o.weight * l.level) AS target FROM o, l),
c AS (
  SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM r GROUP BY ALL),
v AS (
  SELECT c.source, class, words, source_size, target,
    (target - {float(most)} * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(sum(class * words) OVER (PARTITION BY c.source ORDER BY class DESC
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({float(most)}, class * coalesce(
    arg_max(level, class) FILTER (WHERE class * level <= {float(most)}) OVER (PARTITION BY source), {float(most)}))
    ELSE 0 END AS copies
  FROM v),
n AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS p,
    sum((copies - floor(copies)) * words) OVER (PARTITION BY source) AS need
  FROM e),
q AS (
  SELECT r.*, n.source_size, n.target, n.whole, n.need, n.p, (r.draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source AND length(bin(r.size)) = n.class),
k AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q),
m AS (
  SELECT *, sum(size) OVER (PARTITION BY source, p > 0 ORDER BY odds, draw
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through,
    sum(size) OVER (PARTITION BY source, odds, draw) AS alike
  FROM k)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN p > 0 AND 2 * through - alike <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m"""
