"""Product codes of vectors: integer codebooks, nearest entries found by Walsh-Hadamard elimination.

Every component x becomes the integer floor(1024 * x); a vector is cut into
``PARTS`` equal consecutive parts. Each part has a codebook, first filled with
that part of the vectors of smallest id. In each round a task looks up the
nearest entry of its vectors' parts and adds up, per entry, their number and
their components; only these sums are shuffled, and entries become the floors
of their means. What the driver holds and broadcasts is the codebooks: 256
entries of one vector's length, whatever the number of vectors.

The nearest entry is found without floating point. Parts and entries are padded
with zeros to a power of two D and transformed by the unnormalised
Walsh-Hadamard matrix, rows in order of sequency: squared distances of the
transforms are exactly D times those of the parts, and the first coordinates
hold most of them. Squared differences are added up from the first coordinate
on. What an entry has gathered only grows, so an entry is out as soon as that
exceeds the whole distance of one likely entry; equal ones stay, and of the
nearest the lowest index wins.

Defined cases. Vectors that are null or hold null, NaN or infinite components
are dropped. A vector shorter than the longest one, or one that ``PARTS`` does not
divide, counts as padded with zeros at its end. Null ids come after all others;
rows of equal id are ordered by their vectors, and repeated rows count and are
coded each. With fewer vectors than entries the codebooks are that much shorter.
Of no vectors, there are no rows. A component so large that scaled squared
distances would not fit in 64 bits fails the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.tables import map_slices, stored
from redpen.operators.skew import lookup

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Share of the coordinates on which all entries are compared before the first are left out: for
#: unlike vectors, gathering the many entries still in earlier costs more than adding up.
FIRST = 0.75
#: Vectors compared with a codebook at once, so that their sums stay in the cache.
AT_ONCE = 128


def usable(vector: str) -> Column:
    """Is there a vector, and is every component a finite number?"""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    return F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and these as rows of ``width`` integers."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = np.ones(len(sizes), bool)
    good[owner[~np.isfinite(values)]] = False
    good &= vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(sizes), width), np.int64)
    keep = good[owner]
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    scaled = np.floor(values[keep] * SCALE)
    limit = largest(width // PARTS)
    if len(scaled) and np.abs(scaled).max() > limit:
        raise ValueError(f"a component is larger than {limit // SCALE}: distances would not fit in 64 bits")
    rows[owner[keep], place[keep]] = scaled
    return np.flatnonzero(good), rows[good]


def padded_size(width: int) -> int:
    return 1 << max(width - 1, 0).bit_length()


def largest(width: int) -> int:
    """The largest integer component for which D times a squared distance stays below 2 ** 62."""
    return int((2**60 // padded_size(width) ** 2) ** 0.5)


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix by their number of sign changes."""
    return np.argsort((np.diff(transformed(np.eye(size, dtype=np.int64)), axis=1) != 0).sum(axis=1))


def transformed(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; its length is a power of two."""
    out, half = rows, 1
    n, size = rows.shape
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out


def spectrum(rows: np.ndarray) -> np.ndarray:
    """Transforms of zero-padded rows in order of sequency."""
    n, width = rows.shape
    size = padded_size(width)
    padded = np.zeros((n, size), np.int64)
    padded[:, :width] = rows
    return transformed(padded)[:, sequency_order(size)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point of a spectrum: the index of its nearest entry, and D times the squared distance."""
    size = points.shape[1]
    peak = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if size * (2 * peak) ** 2 < 2**31:  # half the memory where all sums fit
        points, entries = points.astype(np.int32), entries.astype(np.int32)
    first = max(1, int(size * FIRST))
    gathered = np.zeros((len(points), len(entries)), points.dtype)
    off = np.empty_like(gathered)
    for at in range(first):
        np.subtract.outer(points[:, at], entries[:, at], out=off)
        np.multiply(off, off, out=off)
        gathered += off
    likely = points - entries[gathered.argmin(axis=1)]
    limit = (likely * likely).sum(axis=1, dtype=points.dtype)
    row, entry = np.nonzero(gathered <= limit[:, None])
    sums = gathered[row, entry]
    at = first
    while at < size:
        to = min(at + max(1, (size - at) // 2), size)
        off = points[row, at:to] - entries[entry, at:to]
        sums = sums + (off * off).sum(axis=1, dtype=points.dtype)
        alive = sums <= limit[row]
        row, entry, sums, at = row[alive], entry[alive], sums[alive], to
    # Pairs are in order of point and entry, and every point still has one.
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(sums, starts) if len(starts) else sums
    hits = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(starts, len(row)))))
    hits = hits[np.append(True, row[hits][1:] != row[hits][:-1])] if len(hits) else hits
    return entry[hits], least


def coded(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and part: the nearest entry of ``books`` (part, entry, place) and its squared distance."""
    width = books.shape[2]
    codes, distances = (np.zeros((len(rows), len(books)), np.int64) for _ in range(2))
    for p, book in enumerate(books):
        points, entries = spectrum(rows[:, p * width : (p + 1) * width]), spectrum(book)
        for at in range(0, len(rows), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            codes[part, p], distances[part, p] = nearest(points[part], entries)
    return codes, distances // padded_size(width)


def first_books(vectors: DataFrame, key: str, vector: str, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors of smallest id. Ids alone are ranked first; then few vectors move."""
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).where(usable("v"))
    by_id = F.col("id").asc_nulls_last()
    ids = rows.select("id").orderBy(by_id).limit(entries)
    edge = ids.agg(F.max("id").alias("last"), F.count("*").alias("n"), F.count("id").alias("known")).first()
    if edge.known == entries:
        rows = rows.where(F.col("id") <= F.lit(edge.last))
    seeds = rows.orderBy(by_id, "v").limit(entries).collect()
    made = integers(pa.array([row.v for row in seeds], pa.list_(pa.float64())), width)[1]
    return np.ascontiguousarray(made.reshape(len(made), PARTS, -1).transpose(1, 0, 2))


def sums(vectors: DataFrame, vector: str, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part and entry: how many parts are nearest to it, and the sums of their components."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts = np.zeros((parts, entries), np.int64)
        totals = np.zeros(books.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                _, rows = integers(batch.column(0).slice(at, 512), parts * width)
                codes, _ = coded(rows, books)
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(totals[p], codes[:, p], rows[:, p * width : (p + 1) * width])
        used = np.flatnonzero(counts.ravel())
        rows = [used.astype(np.int64), counts.ravel()[used]]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(totals.reshape(parts * entries, width)[used].ravel()), width)
        columns = [pa.array(x) for x in rows] + [lists.cast(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "n", "total"])

    per_task = vectors.select(F.col(f"`{vector}`")).mapInArrow(run, "slot long, n long, total array<long>")
    # The count travels as one more component.
    places = per_task.select("slot", F.posexplode(F.concat(F.array("n"), "total")).alias("place", "x"))
    counts, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    # At most one row for each component of the codebooks.
    for row in places.groupBy("slot", "place").agg(F.sum("x").alias("x")).collect():
        if row.place:
            totals[row.slot, row.place - 1] = row.x
        else:
            counts[row.slot] = row.x
    return counts.reshape(parts, entries), totals.reshape(books.shape)


def train(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks (part, entry, place) after all rounds; None without usable vectors."""
    sizes = vectors.select(F.col(f"`{vector}`").alias("v")).where(usable("v")).agg(F.max(F.size("v"))).first()[0]
    if sizes is None:
        return None
    books = first_books(vectors, key, vector, entries, PARTS * max(1, -(-sizes // PARTS)))
    for _ in range(rounds):
        counts, totals = sums(vectors, vector, books)
        used = counts > 0
        books = books.copy()
        books[used] = totals[used] // counts[used][:, None]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, codes, error) of the usable vectors: the entry of each part and the squared distance to all of them."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = [vectors.schema[c].dataType.simpleString() for c in (key, label)]

    def make():
        books = shared.value

        def run(keys: pa.Array, labels: pa.Array, values: pa.Array):
            kept, rows = integers(values, books.shape[0] * books.shape[2])
            if len(kept):
                codes, errors = coded(rows, books)
                yield {
                    "vec_id": keys.take(pa.array(kept)),
                    "label": labels.take(pa.array(kept)),
                    "codes": codes.tolist(),
                    "error": errors.sum(axis=1),
                }

        return run

    return map_slices(
        vectors, [f"`{c}`" for c in (key, label, vector)], make, f"vec_id {kinds[0]}, label {kinds[1]}, codes array<int>, error long"
    )


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **settings) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the usable vectors.

    ``label_error`` is added up per label before rows meet it; a label that holds
    very many rows is spread over as many join keys as it needs.
    """
    books = train(vectors, key, vector, **settings)
    if books is None:
        books = np.zeros((PARTS, 0, 1), np.int64)
    pairs = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    # A null label is one of its own.
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = encode(vectors, books, key, vector, label)
    rows = stored(rows.select("vec_id", name.alias("name"), F.array_join(pairs, "").alias("code"), "error"), "codes")
    totals = rows.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = lookup(rows, totals.drop("n"), "name", F.monotonically_increasing_id(), totals.select("name", "n"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def compress_sql(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same over table ``embeddings`` for DuckDB, by comparing every part with every entry.

    For distinct ids and vectors of one length that ``PARTS`` divides.
    """
    ctes = [
        f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x
  FROM v, range({PARTS}) AS parts(part)),
b0 AS (
  SELECT part, entry, x FROM p
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    ]
    for turn in range(rounds + 1):
        ctes.append(
            f"""a{turn} AS (
  SELECT vec_id, part, p.x AS x, min((list_sum(list_transform(list_zip(p.x, b.x),
    lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry)) AS best
  FROM p JOIN b{turn} AS b USING (part) GROUP BY ALL)"""
        )
        if turn < rounds:
            ctes.append(
                f"""b{turn + 1} AS (
  SELECT part, entry, coalesce(n.x, b.x) AS x FROM b{turn} AS b LEFT JOIN (
    SELECT part, entry, list(floor_mean ORDER BY place) AS x FROM (
      SELECT part, entry, place, (total - ((total % n) + n) % n) // n AS floor_mean FROM (
        SELECT part, entry, place, sum(c)::BIGINT AS total, count(*) AS n FROM (
          SELECT part, best[2] AS entry, unnest(x) AS c, unnest(range(len(x))) AS place FROM a{turn})
        GROUP BY ALL))
    GROUP BY ALL) AS n USING (part, entry))"""
            )
    ctes.append(
        f"""c AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best[2])), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id),
d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})"""
    )
    return "WITH " + ",\n".join(f"{x}" for x in ctes) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (vec_id), d"""
