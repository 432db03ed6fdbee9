"""Least-cost token alignment by the likeness of words, with moved blocks.

Inserting or deleting a token costs ``STEP``. Replacing one costs less the more
alike the words are: their letters, and where token features are given their
lemma and part of speech. A block of neighbouring tokens may turn into the same
tokens in another order: ``SWAP`` for two, ``FARTHER`` for each further one, up
to ``LONGEST``. Both directions cost the same, so the distance is symmetric.

The matrix is filled for whole chunks of pairs, row by row, in a band of diagonals. Only insertions and
deletions leave a diagonal, and those that leave one too many come back: a path of cost k * ``STEP`` stays within half of
what k is more than the difference in length. The cost found in a narrow band thus tells how wide a band holds every
path that is as good, and the next try is exact.

Letters are compared by 64 bits of a word, one place for each letter and the
number of times it came before in the word. Blocks are compared by sums of 64-bit
hashes of their words, upper and lower case alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from redpen.operators import alignment as A

STEP = 100
#: Replacing: upper for lower case; the letters; the lemma; the part of speech, and half of it between open classes.
CASE, LETTERS, LEMMA, POS, OPEN_POS = 10, 100, 49, 50, 25
#: Instead of lemma and part of speech: without features; and between a word and punctuation,
#: which are rather deleted and inserted.
UNKNOWN, UNLIKE = 50, 120
#: More than half of ``SWAP`` for each further token, so that two blocks cost less than one over both.
SWAP, FARTHER, LONGEST = 100, 51, 8
#: Letters at least so alike make words alike.
ALIKE = 25
OPEN_CLASSES = ("NOUN", "VERB", "ADJ", "ADV")

#: Cells of a row of the matrix of a whole chunk: as many as a processor's cache holds a few times.
ROW_CELLS = 1 << 17
#: Pairs of a chunk up to which each is traced back by itself.
FEW = 64
#: Cells of the rows whose costs are found at once.
GROUP_CELLS = 1 << 17
#: Widths of a band between one power of two and the next.
LADDER = 2
#: Letters of a word up to which its bits are found for many words at once.
SHORT = 24

#: Cells on either side of the band that tell which tokens may have moved into it.
ASIDE = LONGEST - 1

MATCH, SUBSTITUTE, DELETE, INSERT = A.MATCH, A.SUBSTITUTE, A.DELETE, A.INSERT
#: A moved block: its first place, and the others.
MOVED, MOVED_ON = 4, 5


def letter_bits(word: str) -> int:
    bits, seen = 0, {}
    for letter in word:
        turn = seen.get(letter, 0)
        seen[letter] = turn + 1
        bits |= 1 << ((ord(letter) * 31 + turn * 17) % 64)
    return bits


def mixed(values: np.ndarray) -> np.ndarray:
    """Pseudo-random 64-bit numbers, one for each value."""
    x = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """Columns of tokens; all arrays of one shape."""

    id: np.ndarray
    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    mark: np.ndarray
    lemma: np.ndarray | None = None
    pos: np.ndarray | None = None
    open: np.ndarray | None = None

    #: Values of places without a token; ids differ by side, so that they never match.
    FILL = {"low": -9, "bits": 0, "size": 1, "mark": False, "lemma": -1, "pos": -9, "open": False}

    def columns(self) -> Iterable[tuple[str, np.ndarray]]:
        return ((k, v) for k, v in vars(self).items() if v is not None)

    def at(self, place) -> Tokens:
        return Tokens(**{k: v[place] for k, v in self.columns()})

    def padded(self, starts, sizes, left: int, width: int, blank: int) -> Tokens:
        rows = np.repeat(np.arange(len(starts)), sizes)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = {}
        for name, flat in self.columns():
            out[name] = np.full((len(starts), width), blank if name in ("id", "low") else self.FILL[name], flat.dtype)
            out[name][rows, step + (left if np.isscalar(left) else left[rows])] = flat[starts[rows] + step]
        return Tokens(**out)


def lowered(words: pa.Array) -> pa.Array:
    """Distinct words in lower case; Arrow's differs from Python's for some letters beyond ASCII."""
    plain = pc.string_is_ascii(words)
    low = pc.ascii_lower(words)
    if pc.all(plain).as_py() is False:
        other = pa.array([w.lower() for w in words.filter(pc.invert(plain)).to_pylist()], words.type)
        low = pc.replace_with_mask(low, pc.invert(plain), other)
    return low


def marks(words: pa.Array) -> np.ndarray:
    """Which of the words hold neither a letter nor a digit."""
    found = ~pc.match_substring_regex(words, "[0-9A-Za-z]").to_numpy(zero_copy_only=False)
    for at in np.flatnonzero(found & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)):
        found[at] = not any(map(str.isalnum, words[int(at)].as_py()))
    return found


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after the other, and where each word's begin."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    if not len(words):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    ends = words.cast(pa.large_string())
    at = np.frombuffer(ends.buffers()[1], np.int64)[ends.offset : ends.offset + len(ends) + 1]
    text = ends.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes().decode() if at[-1] > at[0] else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def all_letter_bits(words: pa.Array) -> np.ndarray:
    """``letter_bits`` of each word, for all words of one length at once."""
    letters, starts = letters_of(words)
    sizes, bits = np.diff(starts), np.zeros(len(words), np.uint64)
    for size in np.unique(sizes):
        who = np.flatnonzero(sizes == size)
        if size > SHORT:
            bits[who] = [letter_bits(words[int(w)].as_py()) for w in who]
            continue
        own = [letters[starts[who] + k] for k in range(size)]
        for k in range(size):
            turn = np.zeros(len(who), np.uint32)
            for before in own[:k]:
                turn += before == own[k]
            bits[who] |= np.uint64(1) << ((own[k] * np.uint32(31) + turn * np.uint32(17)) % np.uint32(64)).astype(np.uint64)
    return bits


def described(values: pa.Array, features: pa.StructArray | None = None) -> Tokens:
    """Columns of all tokens of a batch, both sides together; features have a lemma and a part of speech for each."""
    coded = values.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words = coded.dictionary
    coded_low = lowered(words).dictionary_encode()
    low = coded_low.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    bits = all_letter_bits(coded_low.dictionary)[low]
    size = np.maximum(np.bitwise_count(bits), 1).astype(np.int16)
    out = Tokens(ids, low[ids], bits[ids], size[ids], marks(words)[ids])
    if features is not None:
        lemmas, tags = (features.field(c).dictionary_encode() for c in ("lemma", "pos"))
        code = lambda x: x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        out.lemma, out.pos = code(lemmas), code(tags)
        is_open = np.array([t in OPEN_CLASSES for t in tags.dictionary.to_pylist()] + [False])
        out.open = is_open[out.pos]
    return out


def _letters_table() -> np.ndarray:
    """The cost by the letters of both words and those in common, looked up faster than divided."""
    total, common = np.arange(129)[:, None], np.arange(65)[None, :]
    return np.maximum(LETTERS * (total - 2 * common) // np.maximum(total, 1), 0).astype(np.int32).ravel()


_LETTERS = _letters_table()


def letters_cost(o: Tokens, c: Tokens) -> np.ndarray:
    """0 for the same letters up to ``LETTERS`` for none in common."""
    return _LETTERS.take((o.size + c.size) * np.int16(65) + np.bitwise_count(o.bits & c.bits))


def replacing(o: Tokens, c: Tokens) -> np.ndarray:
    """The cost of replacing each token by the other."""
    if o.lemma is None:
        kind = np.int32(UNKNOWN)
    else:
        lemma = np.where((o.lemma == c.lemma) & (o.lemma >= 0), 0, LEMMA)
        pos = np.where((o.pos == c.pos) & (o.pos >= 0), 0, np.where(o.open & c.open, OPEN_POS, POS))
        kind = (lemma + pos).astype(np.int32)
    kind = np.where(o.mark != c.mark, np.int32(UNLIKE), kind)
    cost = np.maximum(letters_cost(o, c) + kind, CASE + 1)
    cost = np.where(o.low == c.low, np.int32(CASE), cost)
    return np.where(o.id == c.id, np.int32(0), cost)


def moving(length: int) -> int:
    return SWAP + FARTHER * (length - 2)


def _place_table() -> np.ndarray:
    """Cost less ``STEP`` of replacing a token, by the sum of both sides' ``_places`` and the letters in common."""
    one = _LETTERS - STEP
    return np.concatenate([one + UNKNOWN, one + UNLIKE, one + UNKNOWN])


_TABLE = _place_table()


def _places(tokens: Tokens) -> np.ndarray:
    """A token's share of the place in ``_TABLE``: of two shares that hold a mark, none is unlike."""
    return tokens.size * np.int16(65) + tokens.mark * np.int16(len(_LETTERS))


def _ladder(width: np.ndarray) -> np.ndarray:
    """Widths rounded up, so that few differ."""
    step = np.maximum(2 ** np.floor(np.log2(np.maximum(width, 1))).astype(np.int64) // LADDER, 2)
    return -(-width // step) * step


def _unshared(low: np.ndarray, o_off: np.ndarray, c_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each pair's original its correction does not have, each as often as it is missing; and the other way."""
    sides = [np.repeat(np.arange(len(off) - 1), np.diff(off)) for off in (o_off, c_off)]
    words = int(low.max(initial=0)) + 1
    keys = np.concatenate(sides) * words + low
    keys = np.sort(np.concatenate([keys[: o_off[-1]] * 2, keys[o_off[-1] :] * 2 + 1]))
    if not len(keys):
        return np.zeros(len(o_off) - 1, np.int64), np.zeros(len(o_off) - 1, np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] >> 1 != keys[:-1] >> 1))
    more, pair = np.add.reduceat(1 - 2 * (keys & 1), first), (keys[first] >> 1) // words
    return tuple(np.bincount(pair, np.maximum(x, 0), len(o_off) - 1).astype(np.int64) for x in (more, -more))


def _solved(tokens: Tokens, o_off: np.ndarray, c_off: np.ndarray):
    """All pairs with tokens on both sides: which, operations, their number, and the cost."""
    o_start, c_start = o_off[:-1], c_off[:-1] + o_off[-1]
    n, m = np.diff(o_off), np.diff(c_off)
    apart, parts = np.abs(m - n), []
    todo = np.flatnonzero((n > 0) & (m > 0))
    own = _unshared(tokens.low, o_off, c_off)
    # Tokens that the other side does not have and that the difference in length does not explain.
    left = np.maximum(np.maximum(own[0] - np.maximum(n - m, 0), own[1] - np.maximum(m - n, 0)), 0)
    least = UNKNOWN if tokens.lemma is None else CASE + 1

    def needed(which, distance):
        """Diagonals to either side that a path of this cost may use: further ones take two steps each, but spare replacing a token."""
        over, z = distance - apart[which] * STEP, left[which]
        some = (over - least * z) // (2 * STEP - least)
        return np.where(some < z, some, over // (2 * STEP))

    # A guess: each token that the other side does not have costs three quarters of ``STEP``.
    half = 1 + np.maximum(needed(slice(None), np.maximum(sum(own) * 3 // 4, apart) * STEP), 0)
    while len(todo):
        width = _ladder(apart + 2 * half + 1)
        half = (width - 1 - apart) // 2
        todo, again = todo[np.lexsort((-n[todo], width[todo]))], []
        while len(todo):
            w = int(width[todo[0]])
            alike = int(np.searchsorted(width[todo], w, side="right"))
            cells = np.cumsum(n[todo[: min(alike, max(1, ROW_CELLS // w))]]) * w
            take = max(1, int(np.searchsorted(cells, A.CELL_BUDGET)))
            chunk, todo = todo[:take], todo[take:]
            low = np.minimum(m[chunk] - n[chunk], 0) - half[chunk]
            tall = int(n[chunk[0]])
            o = tokens.padded(o_start[chunk], n[chunk], 0, tall, -1)
            c = tokens.padded(c_start[chunk], m[chunk], ASIDE - low, max(tall + w, int((m[chunk] - low).max())) + 2 * ASIDE, -2)
            fits = lambda distance: needed(chunk, distance) <= half[chunk]  # noqa: B023, E731
            ops, lengths, distance = _align_chunk(o, c, n[chunk], m[chunk], low, w, fits)
            fit = fits(distance)
            parts.append((chunk[fit], ops[fit], lengths[fit], distance[fit]))
            half[chunk[~fit]] = needed(chunk[~fit], distance[~fit])
            again.append(chunk[~fit])
        todo = np.concatenate(again)
    return parts


def _sums(low: np.ndarray) -> np.ndarray:
    """Sums of the hashes of all tokens before each place: those of two blocks tell whether they hold the same ones."""
    sums = np.zeros((low.shape[0], low.shape[1] + 1), np.uint64)
    np.cumsum(mixed(low.astype(np.int64)), axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums


def _places_of(yes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``np.nonzero`` of three dimensions, several times faster where few are set."""
    flat, (_, pairs, cells) = np.flatnonzero(yes), yes.shape
    rest, cell = np.divmod(flat, cells)
    return *np.divmod(rest, pairs), cell


def _align_chunk(o: Tokens, c: Tokens, n, m, low, width, fits):
    """As in the plain alignment: a cell holds the cost less ``STEP`` times its column.

    ``low``: the column less the row of each pair's first cells. ``fits`` tells by their costs which pairs are done;
    the others have no operations.
    """
    pairs, rows = len(n), int(n[0])
    kind = np.int32 if (rows + int(m.max())) * 2 * STEP < 1 << 28 else np.int64
    far = kind(1 << (28 if kind is np.int32 else 60))
    running = np.searchsorted(-n, -np.arange(rows), side="left")
    offset = np.concatenate([[0], np.cumsum(running)])
    budget = max(A.CELL_BUDGET // width, int(running[0]))
    block = rows if offset[-1] <= budget else max(LONGEST, int(rows**0.5), budget // pairs)
    distance = np.zeros(pairs, dtype=np.int64)
    edges = offset[np.append(np.arange(0, rows, block), rows)]
    choice = np.empty(int(np.diff(edges).max()) * width, dtype=np.uint8)
    o_sums, c_sums = _sums(o.low), _sums(c.low)
    table = _TABLE.astype(kind)
    shares = (_places(o), _places(c)) if o.lemma is None else None
    wide = width + 2 * ASIDE
    # Written again for each row; the last rows of the matrix come round in turn.
    diagonal, best_two = (np.empty((pairs, width), kind) for _ in range(2))
    ring = np.empty((LONGEST + 1, pairs, width), kind)

    def of_rows(flat, from_, to, k):
        return flat[:k, from_:to].T[:, :, None]

    def of_band(flat, from_, to, k, cells=width, aside=ASIDE):
        return np.lib.stride_tricks.sliding_window_view(flat[:k], cells, axis=1)[:, from_ + aside : to + aside].transpose(1, 0, 2)

    def group(from_, to, k):
        """For these rows: the cost less ``STEP`` of replacing each row's token by each column's, and ``moved_blocks``."""
        early = min(from_, ASIDE)
        equal = of_rows(o.low, from_ - early, to, k) == of_band(c.low, from_ - early, to, k, wide, 0)
        inside = equal[early:, :, ASIDE : ASIDE + width]
        if shares is None:
            mine, theirs = (Tokens(**{x: f(y, from_, to, k) for x, y in side.columns()}) for side, f in ((o, of_rows), (c, of_band)))
            cost = (replacing(mine, theirs) - STEP).astype(kind)
        else:
            place = of_rows(shares[0], from_, to, k) + of_band(shares[1], from_, to, k)
            place += np.bitwise_count(of_rows(o.bits, from_, to, k) & of_band(c.bits, from_, to, k))
            cost = table.take(place, mode="clip")
            row, pair, at = _places_of(equal[early:])
            near = (at >= ASIDE) & (at < ASIDE + width)
            row, pair, at = row[near], pair[near], at[near] - ASIDE
            i = row + from_
            cost[row, pair, at] = np.where(o.id[pair, i] == c.id[pair, at + i + ASIDE], -STEP, CASE - STEP)
        return cost, moved_blocks(equal, inside, early, from_)

    def moved_blocks(equal, inside, early, from_):
        """By row, (size, places) of blocks that end there, the same tokens in another order, their last ones unlike.

        The last token of either side is then one of the ``ASIDE`` before on the other.
        """
        two = equal[:, :, :-1] | equal[:, :, 1:]
        four = two[:, :, :-2] | two[:, :, 2:]
        here = (four[:, :, :-3] | four[:, :, 3:])[early:, :, :width]
        # Up a row, the same column is one cell further on.
        rows_up = np.concatenate([np.zeros((ASIDE - early, *equal.shape[1:]), bool), equal])
        two = rows_up[1:, :, :-1] | rows_up[:-1, :, 1:]
        four = two[2:, :, :-2] | two[:-2, :, 2:]
        up = (four[3:, :, :-3] | four[:-3, :, 3:])[: len(inside), :, ASIDE + 1 : ASIDE + 1 + width]
        found = here & up
        found &= ~inside
        row, pair, at = _places_of(found)
        i, col = row + from_, at + row + from_ + ASIDE
        moved = {}
        for size in range(2, LONGEST + 1) if len(row) else ():
            if size == 2 or (i < size - 1).any():
                there = i >= size - 1
                row, pair, at, i, col = (x[there] for x in (row, pair, at, i, col))
            own = o_sums[pair, i + 1] - o_sums[pair, i + 1 - size]
            same = np.flatnonzero(own == c_sums[pair, col + 1] - c_sums[pair, col + 1 - size])
            for r in np.unique(i[same]):
                who = same[i[same] == r]
                moved.setdefault(int(r), []).append((size, (pair[who], at[who])))
        return moved

    def sweep(before, first, last, keep):
        """Rows ``first`` to ``last`` from the last ``LONGEST`` rows before them."""
        history, upto = list(before), first
        for i in range(first, last):
            k = running[i]
            if i == upto:
                from_, upto = i, min(last, i + max(2 * ASIDE, GROUP_CELLS // (k * wide)))
                costs, blocks = group(from_, upto, k)
            above, d, e, r = history[-1][:k], diagonal[:k], best_two[:k], ring[i % len(ring)][:k]
            np.add(costs[i - from_, :k], above, out=d)
            np.add(above[:, 1:], kind(STEP), out=e[:, :-1])
            e[:, -1] = far
            np.minimum(e, d, out=e)
            moved = []
            for size, at in blocks.get(i, ()):
                cost = history[-size][at] + kind(moving(size) - size * STEP)
                e[at] = np.minimum(e[at], cost)
                moved.append((size, at, cost))
            np.minimum.accumulate(e, axis=1, out=r)
            if keep:
                start = (offset[i] - offset[first]) * width
                code = choice[start : start + k * width].reshape(k, width)
                np.add(r != d, r != e, out=code, dtype=np.uint8)
                for size, at, cost in moved:
                    best = r[at] == cost
                    code[at[0][best], at[1][best]] = size + 1
            history = [*history[1 - LONGEST :], ring[i % len(ring)]]
            done = running[i + 1] if i + 1 < rows else 0
            if done < k:
                ends = np.arange(done, k)
                distance[ends] = r[ends, (m - n - low)[ends]] + m[ends] * STEP
        return history

    top = np.where(np.arange(width) >= -low[:, None], kind(0), far)
    saved, last = {}, [top]
    for first in range(0, rows, block):
        saved[first] = last = last if block >= rows else [x.copy() for x in last]
        last = sweep(last, first, min(first + block, rows), first + block >= rows)

    def trace_one(p, i, j, at, first):
        """One pair's operations back to row ``first``, step by step."""
        mine, theirs, begin = o.id[p].tolist(), c.id[p, ASIDE - low[p] :].tolist(), (p - int(offset[first])) * width - int(low[p])
        out, starts, chosen = memoryview(ops[p]), (offset * width).tolist(), memoryview(choice)
        while i > first or (first == 0 and j > 0):
            step = 2 if i == 0 else 1 if j == 0 else chosen[starts[i - 1] + begin + j - i]
            if step == 0:
                i, j, at = i - 1, j - 1, at - 1
                out[at] = MATCH if mine[i] == theirs[j] else SUBSTITUTE
            elif step < 3:
                at -= 1
                out[at] = step + 1
                i, j = i - (step == 1), j - (step == 2)
            else:
                size = step - 1
                i, j, at = i - size, j - size, at - size
                out[at] = MOVED
                for rest in range(1, size):
                    out[at + rest] = MOVED_ON
        return i, j, at

    traced = np.flatnonzero(fits(distance))
    longest = int((n + m)[traced].max(initial=0))
    ops = np.zeros((pairs, longest), dtype=np.uint8)
    i, j, at = n.astype(np.int64), m.astype(np.int64), np.full(pairs, longest)
    for first in reversed(range(0, rows, block)) if len(traced) else ():
        if first + block < rows:
            sweep(saved[first], first, first + block, True)
        if len(traced) <= FEW:
            for p in traced.tolist():
                i[p], j[p], at[p] = trace_one(p, int(i[p]), int(j[p]), int(at[p]), first)
            continue
        live = traced
        while True:
            li, lj = i[live], j[live]
            on = (li > first) | (lj > 0) if first == 0 else li > first
            if not on.all():
                live, li, lj = live[on], li[on], lj[on]
            if not len(live):
                break
            cell = (offset[np.maximum(li, 1) - 1] - offset[first] + live) * width + lj - li - low[live]
            step = np.where(li == 0, 2, np.where(lj == 0, 1, choice[np.where(li == 0, 0, cell)]))
            size = np.where(step > 2, step - 1, 1)
            at[live] -= size
            same = o.id[live, li - 1] == c.id[live, lj - 1 - low[live] + ASIDE]
            code = np.where(step > 2, MOVED, np.where(step > 0, step + 1, np.where(same, MATCH, SUBSTITUTE)))
            ops[live, at[live]] = code
            for rest in range(1, int(size.max())):
                who = live[size > rest]
                ops[who, at[who] + rest] = MOVED_ON
            i[live] = li - np.where(step == 2, 0, size)
            j[live] = lj - np.where(step == 1, 0, size)
    return ops, longest - at, distance


def align(tokens: Tokens, o_off: np.ndarray, c_off: np.ndarray):
    """Operation codes of all pairs, their row offsets, and the cost of each pair.

    ``tokens``: all originals' tokens, then all corrected ones; offsets count within each side.
    """
    return A.aligned(o_off, c_off, None, STEP, solved=(_solved(tokens, o_off, c_off), np.empty(0, np.int64)))


def edit_spans(
    originals: pa.ListArray, corrected: pa.ListArray, merge: str, o_feats: pa.ListArray | None = None, c_feats: pa.ListArray | None = None
) -> pa.ListArray:
    """Edits of each pair of token lists, by the least cost; a moved block is never divided.

    ``merge``: ``rules`` (see ``merging``), or as in the plain alignment. Features are lists of
    structs with ``lemma`` and ``pos``, one for each token.
    """
    from redpen.operators.merging import rule_cuts

    o_off, c_off = originals.offsets.to_numpy(), corrected.offsets.to_numpy()
    plain = lambda x: x.dictionary_decode() if pa.types.is_dictionary(x.type) else x
    values = pa.concat_arrays([plain(originals.values), plain(corrected.values)])
    feats = None if o_feats is None else pa.concat_arrays([o_feats.values, c_feats.values])
    tokens = described(values, feats)
    ops, rows, _ = align(tokens, o_off, c_off)
    inside = ops[1:] == MOVED_ON
    if merge == "rules":
        pos = None if feats is None else feats.field("pos")
        cut = rule_cuts(ops, rows, tokens, values, len(originals.values), o_off, c_off, pos)
    elif merge == "all-merge":
        cut = np.zeros(max(len(ops) - 1, 0), bool)
    elif merge == "all-equal":
        cut = (ops[:-1] != ops[1:]) & ~inside
    elif merge == "all-split":
        cut = ~inside
    else:
        raise ValueError(f"unknown merge: {merge}")
    return A.spans(originals, corrected, ops, rows, cut)
