"""The trie of conversation prefixes, from sorted conversations and their common prefixes.

A turn becomes a unit of 20 bytes: the MD5 digest of role and text, and the
text's UTF-8 length. A conversation's key is its units in a row, so keys in byte
order hold the conversations that share a prefix side by side. Equal
conversations are one class: its number, its smallest id and the digest of its
ids, which are joined in chunks of ``CHUNK`` ids, so no task sees a popular
conversation id by id.

Classes are sorted by key over range partitions. A task has a run of them, and
the keys just before and after it. It takes the common prefix lengths (LCP) of
neighbours and a sparse table of their range minima. Every prefix of every class
then searches by halving steps, alone and without a stack, how far left and how
far right the minimum stays at its depth or above: that is its interval of
members. The prefix whose left end is its own class stands for the node. All
counts are sums over intervals: members, leaves, children (LCPs equal to the
depth), and bytes of suffixes less those of the turns that a class is first to
have.

A node whose interval reaches beyond its task's run is given in pieces, one for
each run, whose counts add up; only such pieces (prefixes of a run's first or
last key) are shuffled, with the nodes below them that lack their parent's id.

Rebuilding: of the turns of ``c - c % GROUP`` the first h, then those of c after
its own first h, with h = crc32(decimal c) % HEAD; % has the sign of c.

Defined cases. Rows without conv_id are dropped; null role or text is empty;
null turns come first, and equal turns are in order of their units' hexadecimal digits.
Repeated rows are turns of their own. Without conversations there are no nodes,
not even a root. A conversation of many turns is one row of 20 bytes a turn;
its texts stay where they are. Two different turns share a digest with a chance of
n * n / 2**129 among n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpen.llm.tables import stored
from redpen.operators.skew import lookup

UNIT = 20
GROUP, HEAD = 5, 9
#: Ids joined to one text before the texts of a class meet.
CHUNK = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def unit(role: str, text: str) -> Column:
    """A turn's digest and length, as 40 hexadecimal digits."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))
    return F.concat(F.upper(digest), F.lpad(F.hex(F.octet_length(t)), 8, "0"))


def rebuilt(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, key) for every conversation id."""
    c = F.col(f"`{key}`").cast("long")
    rows = turns.where(c.isNotNull()).select(c.alias("conv"), F.col(f"`{turn}`").alias("turn"), unit(role, text).alias("unit"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "unit")))
    own = rows.groupBy("conv").agg(ordered.alias("turns")).select("conv", F.transform("turns", lambda t: t["unit"]).alias("units"))
    # At most GROUP conversations ask for the same one.
    heads = own.select(F.col("conv").alias("base"), F.slice("units", 1, HEAD - 1).alias("lead"))
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD)).cast("int")
    both = own.withColumns({"base": F.col("conv") - F.col("conv") % GROUP, "h": taken}).join(heads, "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("units", F.col("h") + 1, F.greatest(F.size("units"), F.lit(1)))
    return both.select("conv", F.unhex(F.array_join(F.concat(lead, rest), "")).alias("key"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one class, in order of ids, as texts of at most ``CHUNK`` ids."""
    held, ids, made = None, [], []

    def close():
        if ids:
            made.append({"class": held, "least": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))})

    schema = pa.schema([("class", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for kind, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if kind != held or len(ids) == CHUNK:
                close()
                held, ids = kind, []
            ids.append(conv)
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class from its texts in order; no more than one text is held."""
    held, state, least, n, made = None, None, None, 0, []
    schema = pa.schema([("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])

    def close():
        if state is not None:
            made.append({"least": least, "n": n, "ends": state.hexdigest()})

    for batch in batches:
        for kind, first, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if kind != held:
                close()
                held, state, least, n = kind, hashlib.sha256(), first, 0
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += count
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def classes(conversations: DataFrame) -> DataFrame:
    """(key, n, least, ends): distinct conversations, their number, smallest id and the digest of their ids."""
    members = conversations.select(F.unhex(F.md5("key")).alias("class"), "conv").orderBy("class", "conv")
    texts = members.mapInArrow(_chunks, "class binary, least long, n long, ids string")
    by_class = texts.repartition("class").sortWithinPartitions("class", "least")
    found = by_class.mapInArrow(_digests, "least long, n long, ends string")
    return found.join(conversations, F.col("least") == F.col("conv")).select("key", "n", "least", "ends")


class RangeMinimum:
    """Sparse table: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first : last + 1], from two ranges that may overlap."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out

    def reach(self, start: np.ndarray, depth: np.ndarray, way: int) -> np.ndarray:
        """How far from class ``start`` to the right (1) or left (-1) all LCPs stay at ``depth`` or above.

        ``values[i]`` is the LCP of classes i and i + 1.
        """
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            step, row = 1 << k, self.levels[k]
            first = at if way > 0 else at - step
            inside = (first >= 0) & (first < len(row))
            inside[inside] = row[first[inside]] >= depth[inside]
            at[inside] += way * step
        return at


def common_units(a: bytes | None, b: bytes | None) -> int:
    """Length of the common prefix of two keys in units; -1 if there is no such key."""
    if a is None or b is None:
        return -1
    size = min(len(a), len(b)) // UNIT
    differ = np.frombuffer(a, np.uint8, size * UNIT) != np.frombuffer(b, np.uint8, size * UNIT)
    return int(np.argmax(differ)) // UNIT if differ.any() else size


_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, node string, parent string"
)


class Run:
    """A task's sorted classes, with the LCPs to the keys just outside."""

    def __init__(self, keys: list[bytes], n: np.ndarray, least: np.ndarray, before: bytes | None, after: bytes | None):
        self.keys, self.n, self.least = keys, n, least
        self.size = np.array([len(k) // UNIT for k in keys], np.int64)
        self.start = np.cumsum(self.size) - self.size
        units = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, UNIT)
        self.units = np.unique(np.ascontiguousarray(units).view(f"S{UNIT}").ravel(), return_inverse=True)[1]
        lengths = units[:, 16:].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        self.bytes = np.concatenate([[0], np.cumsum(lengths)])
        self.left, self.right = common_units(before, keys[0]), common_units(keys[-1], after)
        self.lcp = self._neighbours()

    def _neighbours(self) -> np.ndarray:
        """LCP of each class and the next one."""
        shorter = np.minimum(self.size[:-1], self.size[1:])
        pair = np.repeat(np.arange(len(shorter)), shorter)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
        differ = np.flatnonzero(self.units[self.start[pair] + place] != self.units[self.start[pair + 1] + place])
        at, first = np.unique(pair[differ], return_index=True)
        out = shorter.copy()
        out[at] = place[differ[first]]
        return out

    def first_bytes(self, i: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Bytes of the first ``turns`` texts of classes ``i``."""
        return self.bytes[self.start[i] + turns] - self.bytes[self.start[i]]

    def prefix_names(self, i: int, depth: int) -> list[str]:
        """Digests of the first 0 to ``depth`` units of class ``i``."""
        state, names = hashlib.md5(), []
        for d in range(depth + 1):
            names.append(state.hexdigest())
            state.update(self.keys[i][d * UNIT : (d + 1) * UNIT])
        return names

    def nodes(self, ends: np.ndarray) -> pa.Table:
        count = len(self.keys)
        minima = RangeMinimum(self.lcp)
        i = np.repeat(np.arange(count), self.size + 1)
        depth = np.arange(len(i)) - np.repeat(np.cumsum(self.size + 1) - self.size - 1, self.size + 1)
        first, last = minima.reach(i, depth, -1), minima.reach(i, depth, 1)
        least = RangeMinimum(self.least).between(first, last)
        from_left = (first == 0) & (depth <= self.left)
        to_right = (last == count - 1) & (depth <= self.right)

        over = lambda x: np.concatenate([[0], np.cumsum(x)])
        inside = lambda sums, a, b: sums[b + 1] - sums[a]
        every = np.arange(count)
        total = self.first_bytes(every, self.size)
        members, texts = over(self.n), over(self.n * total)
        leaves = over(np.append(self.lcp, self.right) < self.size)
        new = over(total - self.first_bytes(every, np.append(0, self.lcp)))
        # LCPs in order of value and place: a node's children begin where the LCP is its depth.
        ranked = np.sort(self.lcp * (count + 1) + np.arange(1, count))

        own = np.flatnonzero(first == i)
        i, d, l, r, cut = i[own], depth[own], first[own], last[own], from_left[own]
        n_convs = inside(members, l, r)
        before = self.first_bytes(l, np.maximum(d - 1, 0))
        begun = np.where(cut, self.first_bytes(l, np.full(len(l), max(self.left, 0)) * cut), before)
        saved = inside(texts, l, r) - n_convs * before - (new[r + 1] - new[l + 1]) - (total[l] - begun)
        upto = lambda x: np.searchsorted(ranked, d * (count + 1) + x, "right")
        n_children = upto(r) - upto(l) + np.where(cut, d == self.left, self.size[l] > d)
        ending = (self.size[l] == d) & ~cut

        open_ = from_left | to_right
        names = np.full(len(open_), None, object)
        for edge, reaches, depth_out in ((0, from_left, self.left), (count - 1, to_right, self.right)):
            if depth_out >= 0:
                chain = np.array(self.prefix_names(edge, depth_out), object)
                names[reaches] = chain[depth[reaches]]
        above = np.maximum(own - 1, 0)
        columns = {
            "conv_id": least[own],
            "depth": d,
            "parent_conv_id": pa.array(least[above], mask=(d == 0) | open_[above]),
            "n_convs": n_convs,
            "n_children": n_children,
            "n_leaves": inside(leaves, l, r),
            "saved_tokens": saved,
            "ends_sha256": pa.array(ends[l], pa.string(), mask=~ending),
            "node": pa.array(names[own], pa.string()),
            "parent": pa.array(np.where(d > 0, names[above], None), pa.string()),
        }
        return pa.table(columns)


def _run_nodes(table: pa.Table, edges: pa.Table) -> pa.Table:
    table = table.sort_by("key")
    edge = edges.to_pylist()[0]
    column = lambda c: table[c].to_numpy()
    run = Run(table["key"].to_pylist(), column("n"), column("least"), edge["before"], edge["after"])
    return run.nodes(np.array(table["ends"].to_pylist(), object))


def trie(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    conversations = stored(rebuilt(turns, **columns), "rebuilt")
    runs = stored(classes(conversations).orderBy("key").withColumn("run", F.spark_partition_id()), "classes")
    # One row for each run.
    order = W.orderBy("run")
    edges = runs.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edges = edges.select("run", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    made = stored(runs.groupBy("run").cogroup(edges.groupBy("run")).applyInArrow(_run_nodes, _NODES), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    pieces = made.where(F.col("node").isNotNull()).groupBy("node", "depth", "parent")
    joined = pieces.agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    joined = stored(joined, "joined-nodes")
    below = made.where(F.col("node").isNull() & F.col("parent").isNotNull()).drop("parent_conv_id")
    lacking = below.unionByName(joined.where("depth > 0"))
    parents = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    counts = lacking.groupBy("parent").agg(F.count("*").alias("n"))
    found = lookup(lacking, parents, "parent", F.struct("conv_id", "depth"), counts)
    whole = made.where(F.col("node").isNull() & F.col("parent").isNull())
    root = joined.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return whole.unionByName(found).unionByName(root).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def trie_sql() -> str:
    """The same over table ``conversations`` for DuckDB: every prefix is a list of its turns."""
    return f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))),
t AS (
  SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, md5(strlen(said.r) || ':' || said.r || said.t)) AS turns
  FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % {HEAD} AS h
  FROM own, crc),
made AS (
  SELECT h.conv_id, list_concat(coalesce(own.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own ON own.conv_id = h.conv_id - h.conv_id % {GROUP}),
p AS (
  SELECT conv_id, len(turns) AS n_turns, unnest(range(len(turns) + 1)) AS depth, turns FROM made),
n AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[depth].t) END AS value
  FROM n LEFT JOIN kids USING (prefix)),
a AS (SELECT prefix, unnest(range(depth + 1)) AS depth, value, n_children FROM v),
s AS (
  SELECT prefix[1:depth] AS prefix, sum(value)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM a GROUP BY ALL)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (prefix) LEFT JOIN n AS up ON v.depth > 0 AND up.depth = v.depth - 1 AND up.prefix = v.prefix[1:v.depth - 1]"""
