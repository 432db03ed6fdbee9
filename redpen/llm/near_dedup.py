"""Near-duplicate components by MinHash bands and sequential Bayesian verification.

1. Narrow pass: each text's set of distinct word shingles gives its size, a
   128-bit digest, a MinHash signature (a byte a value) and its band hashes.
2. Equal sets form a class (partial aggregation by digest); the smallest
   written row number, called doc_id in the inner steps, stands for it.
3. Classes in one band bucket are candidates. Their signatures are compared
   batch by batch; with a uniform prior the similarity's posterior after m of
   n matches is Beta(m + 1, n - m + 1), and a pair is dropped as soon as the
   chance of reaching the threshold is below ``miss``. Survivors are verified
   on the full sets.
   Buckets up to ``SMALL`` members give pairs by a self-join, so their number
   is linear in the members. Classes of larger buckets are never paired by a
   join: those that share large buckets form a block group, which is cut into
   chunks, and tasks compare chunk with chunk in memory by the same batches
   and exact checks. A task leaves out pairs that its own links already
   connect and hands on the others, fewer than its rows. Comparing a group
   costs time with the square of its size, at tens of nanoseconds a pair.
4. Components of the links, by alternating stars. Each is led by its row with
   the smallest id.

Nothing is capped: every candidate is compared or already connected. With 32
bands of 4, a pair of similarity 0.8 misses all buckets once in 2 * 10**7.

Defined cases: null text and text without words have an empty set, no links,
and are kept; fewer words than the shingle's width are one shingle; ties go
to the smallest id, null last, then by the text's digest; rows that repeat an
id and a text are one document, but wordless rows with a null id are one each;
rows with a null id, or one id and different texts, are different documents; a
component of null ids has a null component_id; other columns are not read; an empty table gives no rows; texts may have any length.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.components import components
from redpen.llm.shingles import Shingler, Signer, intersection, set_digest
from redpen.llm.tables import map_slices, stored

BANDS, ROWS = 32, 4
BATCH = 32
#: Members of the largest bucket whose pairs are joined.
SMALL = 32
#: Classes of a chunk of a block group.
CHUNK = 512


def fewest_matches(threshold: float, size: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that stay) after each batch.

    P(similarity >= t | m of n match) with a uniform prior is the chance of at
    most m successes among n + 1 draws of chance t.
    """
    table = []
    for n in range(batch, size + 1, batch):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        table.append((n, m))
    return table


def _tag(text: str) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """doc_id, tag, n, digest, signature and band hashes of every row. Narrow: texts go no further."""

    def make():
        shingler, signer = Shingler(width), Signer(BANDS * ROWS)

        def run(keys, tags, texts):
            made = {"doc_id": keys, "tag": tags, "n": [], "digest": [], "signature": [], "bands": []}
            for value in texts:
                shingles = shingler.shingles(value.as_py())
                made["n"].append(len(shingles))
                if not len(shingles):
                    for name in ("digest", "signature", "bands"):
                        made[name].append(None)
                    continue
                full = signer.signature(shingles)
                made["digest"].append(set_digest(shingles))
                made["signature"].append((full >> np.uint32(24) ^ full & np.uint32(0xFF)).astype(np.uint8).tobytes())
                made["bands"].append(full.tobytes())
            yield made

        return run

    schema = "doc_id long, tag binary, n long, digest binary, signature binary, bands binary"
    own = docs.select(F.col(key).cast("long").alias("doc_id"), _tag(text).alias("tag"), F.col(text).alias("text"))
    return map_slices(own, ["doc_id", "tag", "text"], make, schema)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, doc_id, members, center) of all buckets with two classes or more."""
    one = [F.xxhash64(F.substring("bands", 4 * ROWS * i + 1, 4 * ROWS), F.lit(i)) for i in range(BANDS)]
    rows = stored(classes.select("doc_id", F.explode(F.array(*one)).alias("bucket")), "bands")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("center"))
    return rows.join(shared.where("members > 1").hint("merge"), "bucket")


def _similar_sizes(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _survivors(rows: DataFrame, percent: int, least: list[tuple[int, int]]) -> DataFrame:
    """Pairs of small buckets that the batches leave. ``rows``: bucket, doc_id, n, signature."""
    other = rows.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "signature")])
    pairs = rows.join(other.hint("merge"), "bucket").where(F.col("doc_id") < F.col("doc_id_b"))
    pairs = pairs.where(_similar_sizes("n", "n_b", percent))

    def make():
        def run(a, b, x, y):
            left, right = (
                np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), BANDS * ROWS) for v in (x, y)
            )
            alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, fewest in least:
                matches = matches + np.count_nonzero(left[alive, done:n] == right[alive, done:n], axis=1)
                stay = matches >= fewest
                alive, matches, done = alive[stay], matches[stay], n
            yield {"a": a.take(pa.array(alive)), "b": b.take(pa.array(alive))}

        return run

    columns = ["doc_id", "doc_id_b", "signature", "signature_b"]
    return map_slices(pairs, columns, make, "a long, b long", rows=8192).distinct()


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")

    def make():
        def run(a, b, x, y):
            linked = []
            for left, right in zip(x, y):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                common = intersection(left, right)
                linked.append(100 * common >= percent * (len(left) + len(right) - common))
            mask = pa.array(linked, pa.bool_())
            yield {"a": a.filter(mask), "b": b.filter(mask)}

        return run

    return map_slices(both, ["a", "b", "x", "y"], make, "a long, b long")


class _Parts:
    """Union and find over the rows of a task."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.of[max(x, y)] = min(x, y)
        return x != y


def _block_links(rows: DataFrame, percent: int, least: list[tuple[int, int]]) -> DataFrame:
    """Links that connect the classes of each block group. ``rows``: block, doc_id, n, signature, shingles."""
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = rows.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, sizes, mine = (table[c].to_numpy() for c in ("doc_id", "n", "mine"))
        marks = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(ids), BANDS * ROWS)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["shingles"]]
        same = table["low"][0].as_py() == table["high"][0].as_py()
        low = table["low"][0].as_py()
        parts, found = _Parts(len(ids)), []
        order = np.arange(len(ids))
        for i in range(len(ids)):
            alive = order[i + 1 :] if same else order[mine != low] if mine[i] == low else order[:0]
            near = np.minimum(sizes[alive], sizes[i]) * 100 >= np.maximum(sizes[alive], sizes[i]) * percent
            alive, done = alive[near], 0
            matches = np.zeros(len(alive), np.int64)
            for n, fewest in least:
                matches = matches + np.count_nonzero(marks[alive, done:n] == marks[i, done:n], axis=1)
                stay = matches >= fewest
                alive, matches, done = alive[stay], matches[stay], n
            for j in alive[np.argsort(-matches, kind="stable")].tolist():
                if parts.find(i) != parts.find(j):
                    common = intersection(sets[i], sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        parts.join(i, j)
                        found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    columns = ["block", "low", "high", "doc_id", "n", "mine", "signature", "shingles"]
    return cut.select(*columns).groupBy("block", "low", "high").applyInArrow(compare, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """Full sets of the texts of the wanted rows (doc_id, own_id, tag), from the texts once more."""
    bodies = docs.select(F.col(key).cast("long").alias("id"), _tag(text).alias("own_tag"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("own_tag") == F.col("tag"))
    bodies = bodies.join(wanted.hint("merge"), same).dropDuplicates(["doc_id"])

    def make():
        shingler = Shingler(width)
        return lambda keys, texts: [
            {"doc_id": keys, "shingles": [shingler.shingles(value.as_py()).tobytes() for value in texts]}
        ]

    return map_slices(bodies, ["doc_id", "text"], make, "doc_id long, shingles binary")


def _decided(docs: DataFrame, width: int, percent: int, miss: float, key: str, text: str) -> DataFrame:
    """Per row: doc_id, tag, n_shingles, component_id and kept."""
    least = fewest_matches(percent / 100, BANDS * ROWS, BATCH, miss)
    rows = sketches(docs, width, key, text).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "sketches")
    # Equal sets have equal sizes, signatures and bands, so any row's will do.
    lead = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("own_id"), "tag", "row")
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.min("row").alias("doc_id"), F.min(lead).alias("lead"), *[F.first(c).alias(c) for c in ("n", "signature", "bands")]
    )
    classes = stored(classes, "classes")
    buckets = stored(_buckets(classes), "buckets")
    marks = classes.select("doc_id", "n", "signature")

    small = buckets.where(F.col("members") <= SMALL).select("bucket", "doc_id").join(marks.hint("merge"), "doc_id")
    survivors = stored(_survivors(small, percent, least), "survivors")
    large = buckets.where(F.col("members") > SMALL)
    blocks = stored(components(large.select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()), "blocks")

    wanted = survivors.select(F.col("a").alias("doc_id")).unionByName(survivors.select(F.col("b").alias("doc_id")))
    wanted = wanted.unionByName(blocks.select(F.col("node").alias("doc_id"))).distinct()
    wanted = classes.select("doc_id", "lead.own_id", "lead.tag").join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = stored(_sets(docs, wanted, width, key, text), "sets")
    members = blocks.select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    members = members.join(marks.hint("merge"), "doc_id").join(sets.hint("merge"), "doc_id")
    links = _exact(survivors, sets, percent).unionByName(_block_links(members, percent, least))
    linked = stored(components(links), "components")

    reached = classes.select("digest", "doc_id", "lead").join(linked.hint("merge"), F.col("doc_id") == F.col("node"), "left")
    reached = reached.select("digest", "lead", F.coalesce("component", "doc_id").alias("reached"))
    first = reached.groupBy("reached").agg(F.min("lead").alias("first"))
    reached = reached.join(first.hint("merge"), "reached").select("digest", "first")
    # Adaptive execution splits the rows of a digest that holds many copies.
    out = rows.select("doc_id", "tag", "row", F.col("n").alias("n_shingles"), "digest").join(reached.hint("merge"), "digest", "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.own_id"))
    kept = alone | (F.col("first.row") == F.col("row"))
    return out.select("doc_id", "tag", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    miss: float = 1e-4,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest reachable id) and kept."""
    return _decided(docs, width, percent, miss, key, text).drop("tag")


def keep_first(
    docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component, with all its columns whatever their names."""
    kept = _decided(docs, width, percent, miss, key, text).where("kept")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag"), (F.col("n_shingles") == 0).alias("wordless"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("own_tag", _tag(names[text]))
    same = F.col(names[key]).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("own_tag") == F.col("kept_tag"))
    stays = own.join(kept.distinct().hint("merge"), same)
    single = F.col("wordless") & F.col(names[key]).isNull()
    stays = stays.withColumn("turn", F.when(single, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    stays = stays.dropDuplicates([names[key], "own_tag", "turn"])
    return stays.select([F.col(n).alias(c) for c, n in names.items()])
