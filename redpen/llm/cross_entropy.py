"""Cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary (every word of all documents), one order and
one smoothing; the target model is counted on the documents labelled good, the
background model on all. A document's score is its loss per token under the
target model minus that under the background model: lower means closer to the
target.

What is counted grows with the corpus and is held by no single process. Texts
become blocks of about ``BLOCK_WORDS`` word hashes. A block asks for the corpus
counts of its distinct items: word pairs, words, and words as contexts. Equal
items of all blocks meet in one of 2 ** ``PART_BITS`` or more parts, the first
bits of the item's hash, are added up there, and each block gets its sums back in the order
of its questions. A block asks for an item once however often it holds it, so a
part never has more rows of one item than there are blocks. Sorted items travel
as gaps. Items of frequent words only, at most ``COMMON`` of them in a broadcast
list, are 32-bit numbers and need a third of the bytes; the list decides how an
item is written, never what is counted.

p(w | v) = (n(v, w) + K * p(w)) / (n(v) + K), p(w) = (n(w) + 1) / (n + size),
with K = ``PRIOR`` and size the number of words and one class more, which also
stands before a text's first word.

A word is a run of bytes other than space and 09-0D, with A-Z lower-cased,
known by a 64-bit hash, an item of rarer words by one of 62 bits: among 10**9
distinct items two share one, and add up, with a chance of 1 in 10. With ``size`` only that many of the most frequent words are told
apart, in order of code points where equally frequent, and all others are the
class that stands before the first word. Defined cases: null text is empty; a
text without words has no losses and no score (null); without target documents
the target model is uniform; repeated rows count and score each; several labels
of one document count as good if one is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.shingles import mixed
from redpen.llm.tables import arrow_schema, stored

PRIOR = 50.0
#: Distinct words a task holds before it hands their counts on, or forgets their hashes.
HELD_WORDS = 400_000
#: Words after which a block ends; a text is never cut.
BLOCK_WORDS = 1_000_000
#: Parts of the items are 2 ** this; more from that many times these words on.
PART_BITS, PART_WORDS = 10, 2_500_000
#: Most entries of the list of frequent words, and how often a block must hold a word to name it.
COMMON, OFTEN = 65_535, 8
#: An odd factor spreads the numbers of common items over all parts; its inverse gives them back.
_FACTOR = 0x9E3779B1
_INVERSE = pow(_FACTOR, -1, 1 << 32)
#: The class of other words, and what stands for any word in an item.
OTHER, ANY = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks add up before the shuffle."""

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                for word in words(value.as_py()):
                    held[word] = held.get(word, 0) + 1
                if len(held) > HELD_WORDS:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    counted = docs.select(text).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int, text: str = "text") -> list[bytes]:
    """The ``size`` most frequent words."""
    top = word_counts(docs, text).orderBy(F.col("n").desc(), "word").limit(size)
    return [bytes(row.word) for row in top.collect()]


class Coder(dict):
    """Hashes of words, remembered; ``OTHER`` for words outside ``known``."""

    def __init__(self, known: frozenset[bytes] | None):
        self.known = known

    def __missing__(self, word: bytes) -> int:
        told = self.known is None or word in self.known
        code = min(max(xxhash.xxh64_intdigest(word), int(OTHER) + 1), int(ANY) - 1) if told else int(OTHER)
        self[word] = code
        return code


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: the empty high bytes take no room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(planes), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).ravel()


def gaps(ordered: np.ndarray, base: int) -> bytes:
    return packed(np.diff(ordered, prepend=ordered.dtype.type(base)))


def from_gaps(planes: bytes, kind: type, base: int) -> np.ndarray:
    return np.cumsum(unpacked(planes, kind), dtype=kind) + kind(base)


def frequent_first(times: np.ndarray) -> np.ndarray:
    """The order of a block's words: the class of other words, then by falling count."""
    return np.concatenate([[0], 1 + np.argsort(-times[1:].astype(np.int64), kind="stable")]).astype(np.int64)


_BLOCK = "block long, n_words long, keys array<{}>, counts binary, words binary, times binary, places binary"


def blocks(docs: DataFrame, known: list[bytes] | None, kind: str) -> DataFrame:
    """Blocks of whole texts from (key, text): distinct word hashes, their counts, and each word's place among them."""
    shared = docs.sparkSession.sparkContext.broadcast(None if known is None else frozenset(known))
    schema = _BLOCK.format(kind)
    out = arrow_schema(schema)

    def run(batches):
        coder, first, turn = Coder(shared.value), TaskContext.get().partitionId() << 32, 0
        keys, lists, held = [], [], 0

        def made():
            counts = np.array([len(x) for x in lists], np.int64)
            told = np.concatenate([[OTHER], *lists]).astype(np.uint64)
            codes, places, times = np.unique(told, return_inverse=True, return_counts=True)
            rank = np.empty(len(codes), np.uint32)
            rank[frequent_first(times)] = np.arange(len(codes), dtype=np.uint32)
            coded = packed(counts), gaps(codes, 0), packed(times.astype(np.uint32)), packed(rank[places[1:]])
            row = [first + turn, int(counts.sum()), keys, *coded]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own = words(text.as_py())
                lists.append(np.fromiter(map(coder.__getitem__, own), np.uint64, len(own)))
                keys.append(key.as_py())
                held += len(own) + 1
                if held >= BLOCK_WORDS:
                    yield made()
                    keys, lists, held, turn = [], [], 0, turn + 1
            if len(coder) > HELD_WORDS:
                coder.clear()
        if keys:
            yield made()

    return docs.mapInArrow(run, schema)


def common_words(made: DataFrame) -> np.ndarray:
    """Sorted hashes of at most ``COMMON`` frequent words, the class of other words among them."""

    def run(batches):
        for batch in batches:
            for held, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                times = unpacked(seen, np.uint32)
                often = times >= OFTEN
                codes = from_gaps(held, np.uint64, 0)[often].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times[often].astype(np.int64))], ["word", "n"])

    named = made.select("words", "times").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    named = stored(named.withColumn("grade", F.floor(4 * F.log2("n"))), "common")
    least, room = None, COMMON - 1
    for grade, n in sorted(map(tuple, named.groupBy("grade").count().collect()), reverse=True):
        if n > room:
            break
        least, room = grade, room - n
    rows = named.where(F.col("grade") >= least).select("word").collect() if least is not None else []
    return np.unique(np.array([int(OTHER), *(r.word & int(ANY) for r in rows)], np.uint64))


def numbered(codes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places in the common list from 1, 0 for ``ANY``, ``COMMON`` + 1 for words that are not in it."""
    place = np.minimum(np.searchsorted(common, codes), len(common) - 1)
    return np.where(codes == ANY, 0, np.where(common[place] == codes, place + 1, COMMON + 1)).astype(np.uint64)


def coded(v: np.ndarray, w: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Items as 64 bits. The last bit tells words from other items, the one before numbers from hashes."""
    single = (v == ANY).astype(np.uint64)
    hashed = mixed(v ^ mixed(w)) >> np.uint64(2) << np.uint64(2)
    a, b = numbered(v, common), numbered(w, common)
    number = (a << np.uint64(16) | b) * np.uint64(_FACTOR) & np.uint64(0xFFFFFFFF)
    near = (a <= COMMON) & (b <= COMMON)
    return np.where(near, number << np.uint64(32) | np.uint64(2), hashed) | single


def sent(items: np.ndarray, part: int, bits: int) -> tuple[bytes, bytes]:
    """A part's ordered items: numbers and hashes apart, as gaps."""
    near = items & np.uint64(2) > 0
    numbers = (items[near] >> np.uint64(32)).astype(np.uint32)
    return gaps(numbers, part << (32 - bits)), gaps(items[~near], part << (64 - bits))


def received(near: bytes, far: bytes, part: int, bits: int) -> np.ndarray:
    numbers = from_gaps(near, np.uint32, part << (32 - bits)).astype(np.uint64)
    single = numbers * np.uint64(_INVERSE) & np.uint64(0xFFFFFFFF) < 1 << 16
    numbers = numbers << np.uint64(32) | np.uint64(2) | single.astype(np.uint64)
    return np.sort(np.concatenate([numbers, from_gaps(far, np.uint64, part << (64 - bits))]))


class Block:
    """A block's items, in the order in which it asks for them."""

    def __init__(self, counts: bytes, words: bytes, times: bytes, places: bytes, common: np.ndarray):
        self.counts = unpacked(counts, np.int64)
        self.after = unpacked(places, np.uint32).astype(np.int64)
        codes = from_gaps(words, np.uint64, 0)[frequent_first(unpacked(times, np.uint32))]
        self.size = len(codes)
        self.before = np.concatenate([[0], self.after[:-1]])[: len(self.after)]
        starts = np.cumsum(self.counts) - self.counts
        self.before[starts[self.counts > 0]] = 0
        pairs, self.pair = np.unique(self.before * self.size + self.after, return_inverse=True)
        any_word = np.full(self.size, ANY)
        self.n_pairs = len(pairs)
        v = np.concatenate([codes[pairs // self.size], codes, any_word])
        w = np.concatenate([codes[pairs % self.size], any_word, codes])
        self.item = coded(v, w, common)
        self.order = np.argsort(self.item, kind="stable")

    def totals(self, weights: np.ndarray | None = None) -> np.ndarray:
        count = lambda places, size: np.bincount(places, weights, size)
        own = [count(self.pair, self.n_pairs), count(self.before, self.size), count(self.after, self.size)]
        return np.concatenate(own).astype(np.uint32)

    def split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word of the block: n(v, w), n(v) and n(w), from the sums in order of the questions."""
        placed = np.empty(len(sums))
        placed[self.order] = sums
        pairs, contexts, singles = np.split(placed, [self.n_pairs, self.n_pairs + self.size])
        return pairs[self.pair], contexts[self.before], singles[self.after]


_WORDS = ["counts", "words", "times", "places"]


def targets(made: DataFrame, good: DataFrame) -> DataFrame:
    """(block, good): the places of the target texts in each block that has any. Only keys are shuffled."""
    rows = made.select("block", F.posexplode("keys").alias("place", "own_key"))
    rows = rows.join(good.hint("merge"), F.col("own_key") == F.col("good_key"))
    return rows.groupBy("block").agg(F.collect_list("place").alias("good"))


def questions(made: DataFrame, bits: int, common) -> DataFrame:
    """(part, block, near, far, n, good): a block's items of one part, and how often it holds them."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(*(row[c] for c in _WORDS), common.value)
                flags = np.zeros(len(block.counts))
                flags[row["good"] or []] = 1
                sums = block.totals(), block.totals(np.repeat(flags, block.counts))
                items, n, good = (x[block.order] for x in (block.item, *sums))
                part = (items >> np.uint64(64 - bits)).astype(np.int32)
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)]))
                columns = [pa.array(part[starts]), pa.array(np.full(len(starts), row["block"], np.int64))]
                asked = [sent(items[a:b], int(part[a]), bits) for a, b in spans]
                columns += [pa.array(x, pa.binary()) for x in zip(*asked)]
                columns += [pa.array([packed(x[a:b]) for a, b in spans], pa.binary()) for x in (n, good)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "near", "far", "n", "good"])

    schema = "part int, block long, near binary, far binary, n binary, good binary"
    return made.select("block", *_WORDS, "good").mapInArrow(run, schema)


def _answers(table: pa.Table, bits: int) -> pa.Table:
    """Sums over all blocks for each row's items, and on the first row how many are words and how often these occur."""
    part = table["part"][0].as_py()
    lists = [[received(*x, part, bits) for x in zip(table["near"].to_pylist(), table["far"].to_pylist())]]
    lists += [[unpacked(x, np.uint32) for x in table[c].to_pylist()] for c in ("n", "good")]
    items, place = np.unique(np.concatenate(lists[0]), return_inverse=True)
    ends = np.cumsum([len(x) for x in lists[0]])[:-1]
    single = items & np.uint64(1) > 0
    columns, totals = [], [np.count_nonzero(single)]
    for own in lists[1:]:
        sums = np.bincount(place, np.concatenate(own)).astype(np.int64)
        totals.append(int(sums[single].sum()))
        columns.append(pa.array([packed(x) for x in np.split(sums[place], ends)], pa.binary()))
    columns += [pa.array([total, *[0] * (table.num_rows - 1)], pa.int64()) for total in totals]
    return pa.table([table["part"], table["block"], *columns], ["part", "block", "n", "good", "classes", "n_words", "n_good"])


def loss(pair: np.ndarray, context: np.ndarray, single: np.ndarray, total: float, size: int, prior: float = PRIOR) -> np.ndarray:
    """-log p(w | v) from n(v, w), n(v), n(w) and the numbers of all words and classes."""
    base = (single + 1.0) / (total + size)
    return -np.log((pair + prior * base) / (context + prior))


def losses(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """-log p(w | v) of a square table of pair counts."""
    single = counts.sum(axis=0)
    return loss(counts, counts.sum(axis=1, keepdims=True), single, single.sum(), len(single), prior)


def score(
    docs: DataFrame,
    good: DataFrame,
    size: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: words, loss per word under both models, and the difference.

    ``good`` lists the target documents' keys. Texts are not shuffled.
    """
    known = None if size is None else vocabulary(docs, size, text)
    kind = docs.schema[key].dataType.simpleString()
    made = stored(blocks(docs.select(key, text), known, kind), "blocks")
    ours = stored(targets(made, good.select(F.col(key).alias("good_key")).distinct()), "targets")
    bits = max(PART_BITS, ((made.agg(F.sum("n_words")).first()[0] or 0) // PART_WORDS).bit_length())
    common = docs.sparkSession.sparkContext.broadcast(common_words(made))

    answers = questions(made.join(ours, "block", "left"), bits, common).groupBy("part").applyInArrow(
        lambda table: _answers(table, bits), "part int, block long, n binary, good binary, classes long, n_words long, n_good long"
    )
    answers = stored(answers, "answers")
    # Every block asks for the class of other words too.
    classes, n_all, n_good = (x or 0 for x in answers.agg(*map(F.sum, ("classes", "n_words", "n_good"))).first())
    out = f"`{key}` {kind}, n_tokens long, target_loss double, background_loss double, score double"
    fields = arrow_schema(out)

    def scored(mine: pa.Table, sums: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        block = Block(*(row[c] for c in _WORDS), common.value)
        sums = sums.sort_by("part")
        owner, none = np.repeat(np.arange(len(block.counts)), block.counts), block.counts == 0
        means = []
        for column, total in (("good", n_good), ("n", n_all)):
            got = np.concatenate([unpacked(x, np.int64) for x in sums[column].to_pylist()])
            own = np.bincount(owner, loss(*block.split(got), total, classes), len(none))
            means.append(own / np.maximum(block.counts, 1))
        columns = [pa.array(row["keys"], fields[0].type), pa.array(block.counts)]
        columns += [pa.array(x, mask=none) for x in (*means, means[0] - means[1])]
        return pa.table(columns, schema=fields)

    asked = made.select("block", "keys", *_WORDS).groupBy("block")
    return asked.cogroup(answers.select("block", "part", "n", "good").groupBy("block")).applyInArrow(scored, out)
