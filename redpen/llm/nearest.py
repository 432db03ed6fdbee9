"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table rotates unit vectors by three rounds of random signs and a fast
Hadamard transform; the nearest signed axis is a vector's bucket. A query
looks into its ``probes`` nearest axes of every table. Candidates are reranked
by their exact inner products on the original vectors, summed from the first
component to the last in double precision. Where norms differ, candidates are
hashed with one component more that makes them equal, and queries with a zero
there, so that the nearest angle is the largest inner product. A query that
found fewer than ``k`` of the candidates there are meets all of them.

Equal vectors are one class, of which only the ``k`` + 1 smallest ids can ever
be reported; they are found with a limit inside each task before the shuffle.
Buckets are cut into chunks of about ``CHUNK`` classes, and a query visits all
chunks of its buckets; a task holds one chunk and its queries, block by block.
A task keeps the best ``k`` + 1 ids of each query, so results stay small.

Defined cases: vectors that are null, empty, zero or hold null, NaN or
infinite components take no part, as queries or candidates; vectors of
different lengths never meet; ties go to the smaller id; rows that repeat an
id count once; with fewer than ``k`` candidates all are returned; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpen.llm.tables import map_slices, stored

TABLES, PROBES = 12, 16
#: Vectors of a chunk, and queries multiplied with it at once.
CHUNK, BLOCK = 4096, 512
_CLOSE = 1e-9


def hadamard(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, step = values.shape[-1], 1
    values = values.reshape(-1, n)
    while step < n:
        pairs = values.reshape(len(values), n // (2 * step), 2, step)
        values = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(-1, n)
        step *= 2
    return values / np.sqrt(n)


def rotated(vectors: np.ndarray, table: int, seed: int = 11) -> np.ndarray:
    """Pseudo-rotation number ``table`` of unit vectors, padded to a power of two."""
    size = 1 << max(0, vectors.shape[1] - 1).bit_length()
    random = np.random.Generator(np.random.PCG64([seed, table, size]))
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    for _ in range(3):
        out = hadamard(out * random.choice([-1.0, 1.0], size))
    return out


def nearest_axes(turned: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes, nearest first: axis, or axis + size for its negative."""
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(count, both.shape[1])]


def usable(vector: str) -> Column:
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return value.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(value, lambda x: x != 0)


def _longest(classes: DataFrame) -> dict[int, float]:
    """The largest norm of each length whose vectors' norms differ: a row for each length."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    norms = classes.select(F.size("vector").alias("dim"), norm.alias("norm")).groupBy("dim")
    found = norms.agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return {r.dim: r.most for r in found.collect() if r.least < r.most * (1 - 1e-6)}


def _lifted(vectors: np.ndarray, longest: float | None, asks: bool) -> np.ndarray:
    """Unit vectors; with ``longest``, of one component more by which the candidates' norms become equal."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    if longest is None:
        return vectors / norms
    if asks:
        return np.column_stack([vectors / norms, np.zeros(len(vectors))])
    return np.column_stack([vectors / longest, np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))])


def _placed(classes: DataFrame, tables: int, probes: int, longest: dict[int, float], asks: bool) -> DataFrame:
    """(dim, table, code, class_id, vector, ids): one row for each table and probe."""

    def make():
        def run(keys, lists, ids):
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                rows = pa.array(mine)
                vectors = lists.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), dim).astype(np.float64)
                unit = _lifted(vectors, longest.get(int(dim)), asks)
                for table in range(tables):
                    codes = nearest_axes(rotated(unit, table), probes)
                    again = pa.array(np.repeat(mine, codes.shape[1]))
                    yield {
                        "dim": pa.array(np.full(codes.size, dim, np.int32)),
                        "table": pa.array(np.full(codes.size, table, np.int32)),
                        "code": pa.array(codes.ravel().astype(np.int32)),
                        "class_id": keys.take(again),
                        "vector": lists.take(again),
                        "ids": ids.take(again),
                    }

        return run

    kind = classes.schema["vector"].dataType.simpleString()  # single precision stays single in the shuffle
    schema = f"dim int, table int, code int, class_id long, vector {kind}, ids array<long>"
    return map_slices(classes, ["class_id", "vector", "ids"], make, schema, rows=2048)


def _best(group: pa.Table, k: int) -> pa.Table:
    """Each query's ``k`` + 1 best ids in one chunk, scores negated so that ascending order is best first."""
    group = group.combine_chunks()
    asks = np.array(group["asks"].to_pylist())
    names = group["class_id"].to_numpy()
    vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = vectors.reshape(len(names), -1).astype(np.float64)
    there, here = np.flatnonzero(~asks), np.flatnonzero(asks)
    out_ids, out_best = [], []
    if len(there):
        ids = [group["ids"][int(i)].as_py() for i in there]
        for at in range(0, len(here), BLOCK):
            rows = here[at : at + BLOCK]
            rough = vectors[rows] @ vectors[there].T
            cut = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if len(there) > k + 1 else np.full(len(rows), -np.inf)
            for row, near, least in zip(rows, rough, cut):
                found = np.flatnonzero(near >= least - _CLOSE)
                scores = np.cumsum(vectors[there[found]] * vectors[row], axis=1)[:, -1]
                ranked = sorted((-s, i) for s, f in zip(scores.tolist(), found.tolist()) for i in ids[f])
                out_ids.append(names[row])
                out_best.append([{"far": far, "id": i} for far, i in ranked[: k + 1]])
    kind = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))
    return pa.table({"class_id": pa.array(out_ids, pa.int64()), "best": pa.array(out_best, kind)})


def _met(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(class_id, best): each query's ``k`` + 1 best ids in the buckets it visits."""
    # At most two rows for each component and table.
    counts = index.groupBy("dim", "table", "code").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    counts = F.broadcast(stored(counts, "buckets"))
    index = index.join(counts, ["dim", "table", "code"])
    index = index.withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
    queries = queries.join(counts, ["dim", "table", "code"])
    queries = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["dim", "table", "code", "chunk", "class_id", "vector", "ids", "asks"]
    met = index.select(*columns).unionByName(queries.select(*columns))
    best = met.groupBy("dim", "table", "code", "chunk").applyInArrow(
        lambda group: _best(group, k), "class_id long, best array<struct<far:double,id:long>>"
    )
    # A query's lists meet once; an id found in several tables has the same score in each.
    found = best.repartition("class_id").select("class_id", F.explode("best").alias("hit"))
    found = found.groupBy("class_id", F.col("hit.id").alias("id")).agg(F.min("hit.far").alias("far"))
    found = found.withColumn("turn", F.row_number().over(W.partitionBy("class_id").orderBy("far", "id")))
    return found.where(F.col("turn") <= k + 1).groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("best"))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = TABLES,
    probes: int = PROBES,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest found rows, itself apart."""
    rows = vectors.where(usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")
    )
    rows = stored(rows.where("id IS NOT NULL"), "vectors")
    first = W.partitionBy("vector").orderBy("id")
    # The limit is applied inside each task before rows of equal vectors meet.
    ids = rows.select("vector", "id").withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= k + 1)
    ids = ids.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asked = rows.groupBy("vector").agg(F.max("asks").alias("asks"))
    classes = ids.join(asked, "vector").select(F.element_at("ids", 1).alias("class_id"), "vector", "ids", "asks")
    classes = stored(classes, "vector-classes")

    longest = _longest(classes)
    index = _placed(classes, tables, 1, longest, False).withColumn("asks", F.lit(False))
    none = F.array().cast("array<bigint>")
    queries = _placed(classes.where("asks"), tables, probes, longest, True).withColumns({"ids": none, "asks": F.lit(True)})
    merged = stored(_met(index, queries, k), "nearest")

    there = rows.groupBy(F.size("vector").alias("dim")).agg(F.countDistinct("id").alias("there"))
    got = merged.select("class_id", F.size("best").alias("got"))
    short = classes.where("asks").join(got, "class_id", "left").withColumn("dim", F.size("vector")).join(there, "dim")
    short = short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), F.col("there")))
    short = stored(short.select("dim", "class_id", "vector"), "short")
    if not short.isEmpty():
        one = {"table": F.lit(0), "code": F.lit(0)}
        everything = classes.withColumns({"dim": F.size("vector"), "asks": F.lit(False)} | one)
        everything = everything.join(short.select("dim").distinct(), "dim", "left_semi")
        exact = _met(everything, short.withColumns({"ids": none, "asks": F.lit(True)} | one), k)
        merged = merged.join(short.select("class_id"), "class_id", "left_anti").unionByName(exact)

    query_rows = rows.where("asks").select("id", "vector").distinct()
    query_rows = query_rows.join(classes.where("asks").select("class_id", "vector"), "vector").select("id", "class_id")
    mine = query_rows.join(merged, "class_id").select(
        F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best")
    )
    ranked = mine.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )
