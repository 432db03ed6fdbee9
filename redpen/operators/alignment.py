"""Minimum-edit token alignment of one Arrow batch of sentence pairs.

The dynamic program is vectorized over pairs: each step computes one matrix row
of a whole chunk. Only a diagonal band is filled; it is widened until it is
provably wide enough, so results are exact at any length. Rows too long to keep
are recomputed from saved ones, which bounds memory per task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MATCH, SUBSTITUTE, DELETE, INSERT = range(4)
FAR = np.int32(1 << 28)
CELL_BUDGET = 8_000_000
#: Bytes of text whose tokens are held at once.
TEXT_BUDGET = 8 << 20
#: Distinct words that are added up before they are handed on.
WORDS_HELD = 1 << 20
#: Tokens of a pair for each further operation that it is first thought to need.
THINNER = 16
#: Most operations of a pair whose rows are numbers of that many bits; 0: none are.
THIN = 63
#: Cells of a pair up to which its rows may be whole integers: their bits are kept.
ALONE = 1 << 28
#: Time of a row of a few pairs side by side, in rows of one pair alone.
ROW_COST = 20


def _padded(flat, starts, sizes, left, width, fill):
    """Rows of ``flat`` as a matrix with ``left`` fill columns first, as many for all or for each."""
    out = np.full((len(starts), width), fill, dtype=np.int32)
    rows = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at + (left if np.isscalar(left) else left[rows])] = flat[starts[rows] + at]
    return out


def _align_chunk(o, c, n, m, band):
    """Operations of each pair, right-aligned, with their count; and the distance.

    Pairs come longest original first, so the ones still running at a row are a
    leading slice. A cell holds the distance minus its column, which makes the
    insertion step a running minimum.
    """
    pairs, rows, width = len(n), int(n[0]), 2 * band + 1
    running = np.searchsorted(-n, -np.arange(rows), side="left")
    offset = np.concatenate([[0], np.cumsum(running)])
    budget = max(CELL_BUDGET // width, int(running[0]))
    block = rows if offset[-1] <= budget else max(1, int(rows**0.5), budget // pairs)
    distance = np.zeros(pairs, dtype=np.int32)
    edges = offset[np.append(np.arange(0, rows, block), rows)]
    choice = np.empty(int(np.diff(edges).max()) * width, dtype=np.uint8)

    def sweep(prev, first, last, keep):
        diag, row = np.empty_like(prev), prev.copy()
        above = np.full_like(prev, FAR)
        for i in range(first, last):
            k = running[i]
            p, d, a = row[:k].copy(), diag[:k], above[:k]
            np.subtract(p, c[:k, i : i + width] == o[:k, i, None], out=d)
            np.add(p[:, 1:], 1, out=a[:, :-1])
            r = row[:k]
            np.minimum(d, a, out=r)
            np.minimum.accumulate(r, axis=1, out=r)
            if keep:
                start = (offset[i] - offset[first]) * width
                side = r != d
                code = choice[start : start + k * width].reshape(k, width)
                np.add(side, side & (r != a), out=code, dtype=np.uint8)
            done = running[i + 1] if i + 1 < rows else 0
            if done < k:
                ends = np.arange(done, k)
                distance[ends] = row[ends, m[ends] - n[ends] + band] + m[ends]
        return row

    top = np.full((pairs, width), FAR, dtype=np.int32)
    top[:, band:] = 0
    saved, last = {}, top
    for first in range(0, rows, block):
        saved[first] = last
        last = sweep(last, first, min(first + block, rows), first + block >= rows)
    if band < max(rows, int(m.max())) and (distance > band).any():
        return None, None, distance

    longest = int((n + m).max())
    ops = np.zeros((pairs, longest), dtype=np.uint8)
    i, j, at = n.astype(np.int64), m.astype(np.int64), np.full(pairs, longest)
    for first in reversed(range(0, rows, block)):
        if first + block < rows:
            sweep(saved[first], first, first + block, True)
        live = np.arange(pairs)
        while True:
            li, lj = i[live], j[live]
            on = (li > first) | (lj > 0) if first == 0 else li > first
            if not on.all():
                live, li, lj = live[on], li[on], lj[on]
            if not len(live):
                break
            cell = (offset[np.maximum(li, 1) - 1] - offset[first] + live) * width + lj - li + band
            step = np.where(li == 0, 2, np.where(lj == 0, 1, choice[np.where(li == 0, 0, cell)]))
            diagonal = step == 0
            same = o[live, li - 1] == c[live, lj - 1 + band]
            at[live] -= 1
            ops[live, at[live]] = np.where(diagonal, np.where(same, MATCH, SUBSTITUTE), step + 1)
            i[live] = li - (step != 2)
            j[live] = lj - (step != 1)
    return ops, longest - at, distance


def _align_thin(o, c, n, m, k):
    """Operations of each pair as ``_align_chunk`` gives them, right only where the distance is at most ``k``.

    One bit stands for a cell: a row of the band is a number of ``k`` + 1 bits, and those of all pairs lie side by
    side. The bits tell where the distance grows from cell to cell; an addition carries a step along the row. Bit 0 is the
    least column less row that ``_lowest`` names; ``c`` starts with as many fill rows.
    """
    pairs, rows, bits = len(n), int(n[0]), k + 1
    word = np.dtype(f"u{bits // 8}").type
    low = _lowest(n, m, k)
    running = np.searchsorted(-n, -np.arange(rows), side="left")
    offset = np.concatenate([[0], np.cumsum(running)])
    # Whether the diagonal step is not the best, and which of the other two is.
    aside, which = np.empty(offset[-1], word), np.empty(offset[-1], word)
    one, last = word(1), word(1 << k)
    value = (one << np.arange(bits, dtype=word))[:, None]
    # The distance falls towards column 0 and grows from there on.
    less = ~(~word(0) << (-low).astype(word) << one)
    more = ~less
    for i in range(rows):
        r = running[i]
        p, q = more[:r], less[:r]
        np.right_shift(p, one, out=p)
        np.bitwise_or(p, last, out=p)
        np.right_shift(q, one, out=q)
        same = c[i : i + bits, :r] == o[i, :r]
        equal = np.add.reduce(np.multiply(same, value, dtype=word), axis=0, dtype=word)
        level = equal & p
        np.add(level, p, out=level)
        np.bitwise_xor(level, p, out=level)
        np.bitwise_or(level, equal, out=level)
        np.bitwise_or(level, q, out=level)
        down = ~(level | p)
        np.bitwise_or(down, q, out=down)
        up = level & p
        side, other = aside[offset[i] : offset[i + 1]], which[offset[i] : offset[i + 1]]
        np.bitwise_and(level, ~equal, out=side)
        np.bitwise_and(level, down, out=other)
        np.bitwise_or(other, equal, out=other)
        np.invert(other, out=other)
        np.left_shift(down, one, out=down)
        np.bitwise_or(down, one, out=down)
        np.left_shift(up, one, out=up)
        np.bitwise_and(level, down, out=q)
        np.bitwise_or(level, down, out=p)
        np.invert(p, out=p)
        np.bitwise_or(p, up, out=p)

    # From the last row up: the operation that uses each original token, and the insertions after it.
    at = (m - n - low).astype(word)
    used, inserted = np.zeros((rows, pairs), np.uint8), np.zeros((rows + 1, pairs), np.int32)

    def steps(first, who, column):
        return (which[first + who] >> column & one | (aside[first + who] >> column & one) << one).astype(np.uint8)

    who = np.arange(pairs)
    for i in reversed(range(rows)):
        r = running[i]
        step = steps(offset[i], who[:r], at[:r])
        more = np.flatnonzero(step == INSERT)
        while len(more):
            inserted[i + 1, more] += 1
            at[more] -= one
            step[more] = steps(offset[i], more, at[more])
            more = more[step[more] == INSERT]
        used[i, :r] = step
        at[:r] += step == DELETE
    inserted[0] = at.astype(np.int64) + low
    before = np.cumsum(inserted, axis=0, dtype=np.int32)
    lengths = n + before[-1]
    longest = int(lengths.max())
    ops = np.full((pairs, longest), INSERT, dtype=np.uint8)
    i, p = np.nonzero(np.arange(rows)[:, None] < n)
    ops[p, (longest - lengths)[p] + before[i, p] + i] = used[i, p]
    return ops, lengths, before[-1] + np.count_nonzero(used, axis=0)


def _lowest(n, m, k):
    """The least column less row on any way of at most ``k`` operations through each pair's matrix."""
    return np.minimum(m - n, 0) - (k - np.abs(m - n)) // 2


def _align_one(o, c):
    """Operations of one pair, whose rows are whole Python integers: ``_align_thin`` without a band."""
    full = (1 << len(c)) - 1
    where = {}
    for j, token in enumerate(c):
        where[token] = where.get(token, 0) | 1 << j
    more, less, kept = full, 0, []
    for token in o:
        equal = where.get(token, 0)
        level = (((equal & more) + more ^ more) | equal | less) & full
        down = less | full ^ (level | more)
        up = level & more
        kept.append((level, level & down))
        down = (down << 1 | 1) & full
        more, less = (up << 1 & full) | full ^ (level | down), level & down
    ops, i, j = bytearray(), len(o) - 1, len(c) - 1
    while i >= 0 and j >= 0:
        if o[i] == c[j]:
            step = MATCH
        else:
            level, down = kept[i]
            step = SUBSTITUTE if not level >> j & 1 else DELETE if down >> j & 1 else INSERT
        ops.append(step)
        i -= step != INSERT
        j -= step != DELETE
    ops += bytes([DELETE]) * (i + 1) + bytes([INSERT]) * (j + 1)
    return np.frombuffer(bytes(ops[::-1]), np.uint8)


def _solved_thin(o_flat, o_off, c_flat, c_off):
    """Parts of ``align`` by rows of bits, each pair with the fewest bits that hold its distance; and the pairs left over."""
    n, m = np.diff(o_off), np.diff(c_off)
    size, parts = np.maximum(n, m), []
    todo = np.nonzero((n > 0) & (m > 0))[0]
    if not THIN:
        return parts, todo
    guess = (np.abs(n - m) + 2 + size // THINNER)[todo]
    left = []
    for k in [x for x in (7, 15, 31, 63) if x <= THIN]:
        mine, later = todo[guess <= k], guess > k
        mine = mine[np.argsort(-n[mine], kind="stable")]
        todo, guess = todo[later], guess[later]
        # The longest ones alone, where a row of a few pairs takes longer than their own rows.
        own = n[mine] * m[mine] <= ALONE
        alone = np.cumsum(n[mine]) - n[mine] + ROW_COST * n[mine]
        lone = int(np.argmin(np.append(alone, n[mine].sum()))) if own.all() else 0
        left.append(mine[:lone])
        mine = mine[lone:]
        while len(mine):
            take = max(1, int(np.searchsorted(np.cumsum(n[mine]) * (k + 1), CELL_BUDGET)))
            chunk, mine = mine[:take], mine[take:]
            tall, low = int(n[chunk[0]]), -_lowest(n[chunk], m[chunk], k)
            o = _padded(o_flat, o_off[:-1][chunk], n[chunk], 0, tall, -1).T.copy()
            c = _padded(c_flat, c_off[:-1][chunk], m[chunk], low, max(tall + k, int((m[chunk] + low).max())), -2).T.copy()
            ops, lengths, distance = _align_thin(o, c, n[chunk], m[chunk], k)
            fits = distance <= k
            parts.append((chunk[fits], ops[fits], lengths[fits], distance[fits]))
            # What was found is a bound, so the next try fits.
            todo, guess = np.append(todo, chunk[~fits]), np.append(guess, distance[~fits])
    left = np.concatenate([*left, todo])
    own = n[left] * m[left] <= ALONE
    for who in left[own]:
        o, c = o_flat[o_off[who] : o_off[who + 1]], c_flat[c_off[who] : c_off[who + 1]]
        ops = _align_one(o.tolist(), c.tolist())
        parts.append((np.array([who]), ops[None], np.array([len(ops)]), np.array([np.count_nonzero(ops)])))
    return parts, left[~own]


def align(o_flat, o_off, c_flat, c_off):
    """Operation codes of all pairs as one flat array plus row offsets."""

    def solve(chunk, n, m, k):
        tall = int(n[0])
        o = _padded(o_flat, o_off[:-1][chunk], n, 0, tall, -1)
        c = _padded(c_flat, c_off[:-1][chunk], m, k, max(tall + 2 * k, int(m.max()) + k), -2)
        return _align_chunk(o, c, n, m, k)

    return aligned(o_off, c_off, solve, solved=_solved_thin(o_flat, o_off, c_flat, c_off))[:2]


def aligned(o_off, c_off, solve, step=1, solved=None):
    """Operation codes of all pairs as one flat array, row offsets, and costs.

    ``solve(chunk, n, m, band)`` aligns some pairs, longest original first, and gives no
    operations if the band may be too narrow. A token inserted or deleted costs ``step``. ``solved``: parts
    that are there already, and the pairs that are not among them.
    """
    n, m = np.diff(o_off), np.diff(c_off)
    one_sided = np.nonzero((n == 0) | (m == 0))[0]
    longest = int((n + m)[one_sided].max(initial=0))
    fill = np.where(n[one_sided] > 0, DELETE, INSERT).astype(np.uint8)
    parts = [(one_sided, np.repeat(fill[:, None], longest, 1), (n + m)[one_sided])]
    costs = (n + m) * step
    done, todo = solved or ([], np.nonzero((n > 0) & (m > 0))[0])
    for who, ops, lengths, distance in done:
        parts.append((who, ops, lengths))
        costs[who] = distance

    def pow2(x):
        return 1 << np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)

    size = np.maximum(n, m)
    band = np.minimum(pow2(np.abs(n - m) + 2 + size // 8), pow2(size))
    todo = todo[np.lexsort((-n[todo], band[todo]))]
    while len(todo):
        k = int(band[todo[0]])
        alike = int(np.searchsorted(band[todo], k, side="right"))
        cells = np.cumsum(n[todo[:alike]]) * (2 * k + 1)
        take = max(1, int(np.searchsorted(cells, CELL_BUDGET)))
        chunk, todo = todo[:take], todo[take:]
        ops, lengths, distance = solve(chunk, n[chunk], m[chunk], k)
        if ops is None:
            narrow = (distance > k * step) & (size[chunk] > k)
            band[chunk[narrow]] = np.minimum(4 * k, pow2(size[chunk[narrow]]))
            todo = np.concatenate([todo, chunk])
            todo = todo[np.lexsort((-n[todo], band[todo]))]
        else:
            parts.append((chunk, ops, lengths))
            costs[chunk] = distance

    lengths = np.zeros(len(n), dtype=np.int64)
    for who, _, count in parts:
        lengths[who] = count
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(offsets[-1], dtype=np.uint8)
    for who, ops, count in parts:
        rows = np.repeat(np.arange(len(who)), count)
        pos = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        flat[offsets[who][rows] + pos] = ops[rows, (ops.shape[1] - count)[rows] + pos]
    return flat, offsets, costs


def _joined(values, starts, ends):
    """Space-joined token slices."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    words = values.take(pa.array(take, pa.int64()))
    if pa.types.is_dictionary(words.type):
        words = words.dictionary_decode()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def token_lists(texts: pa.Array) -> pa.ListArray:
    """Whitespace-separated tokens of each text; null counts as empty text."""
    split = pc.utf8_split_whitespace(texts.fill_null(""))
    words = split.flatten()
    # White space at either end of a text leaves an empty token there.
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    kept = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(kept[ends], pa.int32()), words.filter(pa.array(full)))


def parts(*texts: pa.Array):
    """Slices of rows with at most ``TEXT_BUDGET`` bytes of text together, or one row; at least one slice."""
    weight = sum(pc.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in texts)
    total = np.concatenate([[0], np.cumsum(weight)])
    at, rows = 0, len(texts[0])
    while True:
        end = max(at + 1, int(np.searchsorted(total, total[at] + TEXT_BUDGET, side="right")) - 1)
        yield slice(at, end)
        if end >= rows:
            return
        at = end


def word_counts(texts: pa.Array):
    """Distinct tokens and their number, as two arrays for each part of the texts."""
    for part in parts(texts):
        yield token_lists(texts[part]).values.value_counts().flatten()


def summed(counts: Iterable[tuple[pa.Array, pa.Array]]):
    """Words and their number from ``word_counts`` of many texts, those of many parts together in each table.

    At most about twice ``WORDS_HELD`` words are held at once.
    """
    held, size, least = [], 0, 0
    for words, n in counts:
        held.append(pa.table([words, n], ["word", "n"]))
        size += len(words)
        if size - least > WORDS_HELD:
            held = [_added(held)]
            size = least = len(held[0])
            if size > WORDS_HELD:
                yield held.pop()
                size = least = 0
    if held:
        yield _added(held)


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _common_run(left, right, l_from, r_from, sizes, step):
    """How many of at most ``sizes`` tokens agree one after the other, from these places on."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = np.arange(int(sizes.sum())) * step
    differ = left[at + np.repeat(l_from - step * starts, sizes)] != right[at + np.repeat(r_from - step * starts, sizes)]
    differ = np.flatnonzero(differ)
    rows = np.searchsorted(ends, differ, side="right")
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    run = sizes.copy()
    run[rows[first]] = differ[first] - starts[rows[first]]
    return run


def _places(sizes):
    """Row and place in the row of every token of rows of these sizes."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def trimmed(originals: pa.ListArray, corrected: pa.ListArray, which=None):
    """The token lists without their common start and, of the rest, common end; and the start's lengths.

    The lists come back with their values dictionary-encoded, both by the same dictionary. ``which``: the number of
    each pair's original, if several share one.
    """
    o_off, c_off = (x.offsets.to_numpy().astype(np.int64) for x in (originals, corrected))
    o_from, o_to = (x if which is None else x[which] for x in (o_off[:-1], o_off[1:]))
    n, m = o_to - o_from, np.diff(c_off)
    coded = pa.concat_arrays([originals.values, corrected.values]).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    o, c = ids[: len(originals.values)], ids[len(originals.values) :]
    lead = _common_run(o, c, o_from, c_off[:-1], np.minimum(n, m), 1)
    tail = _common_run(o, c, o_to - 1, c_off[1:] - 1, np.minimum(n, m) - lead, -1)

    def middle(side, starts, sizes):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        words = pa.DictionaryArray.from_arrays(pa.array(side[at], pa.int32()), coded.dictionary)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)

    return middle(o, o_from + lead, n - lead - tail), middle(c, c_off[:-1] + lead, m - lead - tail), lead


def _own_texts(texts: pa.Array):
    """The texts that differ from the one before, and the number of each row's among them."""
    texts = texts.fill_null("")
    own = np.ones(len(texts), bool)
    own[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
    return texts.filter(pa.array(own)), np.cumsum(own) - 1


def text_spans(originals: pa.Array, corrected: pa.Array, find, *features: pa.ListArray) -> pa.ListArray:
    """Edits of each pair of texts; ``find`` gives those of token lists without common ends.

    Positions count from the start of the whole text. Texts are taken in parts of at most
    ``TEXT_BUDGET`` bytes, or one pair. ``features``: lists of structs with ``lemma`` and ``pos`` for the tokens of either side.
    """
    found = []
    for part in parts(originals, corrected):
        # Both corrections of a sentence come one after the other: it is split once.
        own, which = _own_texts(originals[part])
        *middles, lead = trimmed(token_lists(own), token_lists(corrected[part]), which)
        feats = [_features(f[part], lead, mid) for f, mid in zip(features, middles)]
        found.append(_shifted(find(*middles, *feats), lead))
    return pa.concat_arrays(found)


def _features(feats: pa.ListArray, lead, middle: pa.ListArray) -> pa.ListArray:
    """The features of the middle's tokens; unknown where the list ends before, or is missing."""
    sizes = pc.list_value_length(feats).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    rows, at = _places(np.diff(middle.offsets.to_numpy()))
    place = lead[rows] + at
    take = pa.array(starts[rows] + place, pa.int64(), mask=place >= sizes[rows])
    kind = feats.type.value_type
    columns = dict(zip([kind.field(k).name for k in range(kind.num_fields)], feats.flatten().flatten()))
    values = pa.StructArray.from_arrays([columns[c].take(take) for c in ("lemma", "pos")], ["lemma", "pos"])
    return pa.ListArray.from_arrays(middle.offsets, values)


def _shifted(found: pa.ListArray, lead) -> pa.ListArray:
    """Edits whose positions count ``lead`` more tokens in each row."""
    by = np.repeat(lead, np.diff(found.offsets.to_numpy()))
    edits, names = found.values, [f.name for f in found.type.value_type]
    moved = lambda name: pa.array(edits.field(name).to_numpy() + by, pa.int32())
    columns = [edits.field(name) if name.endswith("_str") else moved(name) for name in names]
    return pa.ListArray.from_arrays(found.offsets, pa.StructArray.from_arrays(columns, names=names))


def edit_spans(originals: pa.ListArray, corrected: pa.ListArray, merge: str) -> pa.ListArray:
    """Edits of each pair of token lists, by the fewest operations.

    Dictionary-encoded tokens need the same dictionary on both sides. ``merge`` joins
    neighbouring operations: ``all-merge`` every run without a match, ``all-equal`` runs of
    one operation, ``all-split`` none.
    """
    o_off, c_off = originals.offsets.to_numpy(), corrected.offsets.to_numpy()
    if pa.types.is_dictionary(originals.type.value_type):
        o, c = (x.values.indices.to_numpy() for x in (originals, corrected))
    else:
        ids = pa.concat_arrays([originals.values, corrected.values]).dictionary_encode()
        ids = ids.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        o, c = ids[: len(originals.values)], ids[len(originals.values) :]
    ops, rows = align(o, o_off, c, c_off)
    if merge == "all-merge":
        cut = np.zeros(max(len(ops) - 1, 0), bool)
    elif merge == "all-equal":
        cut = ops[:-1] != ops[1:]
    elif merge == "all-split":
        cut = np.ones(max(len(ops) - 1, 0), bool)
    else:
        raise ValueError(f"unknown merge: {merge}")
    return spans(originals, corrected, ops, rows, cut)


def spans(originals: pa.ListArray, corrected: pa.ListArray, ops, rows, cut) -> pa.ListArray:
    """Edits of each pair; ``cut`` tells where one ends between two neighbouring operations."""
    o_off, c_off = originals.offsets.to_numpy(), corrected.offsets.to_numpy()
    edit = ops != MATCH
    first = np.zeros(len(ops) + 1, dtype=bool)
    first[rows] = True
    cut = first[1:-1] | ~edit[:-1] | ~edit[1:] | cut if len(ops) else first[:0]
    opens = np.nonzero(edit & np.concatenate([[True], cut])[: len(ops)])[0]
    closes = np.nonzero(edit & np.concatenate([cut, [True]])[: len(ops)])[0]

    row_of = np.searchsorted(rows, opens, side="right") - 1
    o_seen = np.concatenate([[0], np.cumsum(ops != INSERT)])
    c_seen = np.concatenate([[0], np.cumsum(ops != DELETE)])
    o_base, c_base = o_seen[rows[:-1]][row_of], c_seen[rows[:-1]][row_of]
    o_start, o_end = o_seen[opens] - o_base, o_seen[closes + 1] - o_base
    c_start, c_end = c_seen[opens] - c_base, c_seen[closes + 1] - c_base

    o_at, c_at = o_off[:-1][row_of], c_off[:-1][row_of]
    ints = [pa.array(x, pa.int32()) for x in (o_start, o_end, c_start, c_end)]
    texts = [
        _joined(originals.values, o_at + o_start, o_at + o_end),
        _joined(corrected.values, c_at + c_start, c_at + c_end),
    ]
    names = ["o_start", "o_end", "c_start", "c_end", "o_str", "c_str"]
    counts = np.bincount(row_of, minlength=len(originals))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(ints + texts, names=names)
    )
