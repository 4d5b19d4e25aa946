"""Edit similarity of many pairs at once: Levenshtein distances over characters, whatever the length.

What a pair has in common at its beginning and its end is cut off first, which changes no distance. Long texts are cut
into pieces at places that look alike; where the pieces' distances add up to what is allowed, the texts are alike. What
is left takes bits (Myers, in blocks of 64 as Hyyro has them), each numpy operation for all blocks of all pairs of a
batch, along the diagonals that the distance asked for allows (Ukkonen). Where fewer than FEW pairs come, or FEW_LONG of
about a length above CHARACTERS, a column of bits is one Python integer, which costs the same whatever comes with it, and beyond INTEGERS characters
they go by diagonals (Landau and Vishkin): after e edits it is kept how far each diagonal reaches, so the cost grows with
the length and the square of the distance. Both of these end where the distance is known to be too much.
"""

from __future__ import annotations

import numpy as np

CHARACTERS = 512
INTEGERS = 16_384
#: Pairs that make a batch, and of those longer than CHARACTERS of about a length.
FEW, FEW_LONG = 64, 16
#: Edits for which the first diagonals do.
FIRST = 48
#: Characters of a piece of a long text, and of those that must be equal where one begins.
PIECE, _ANCHOR = 256, 16
#: Characters up to which all diagonals are looked at.
_SHORT = 128
#: Characters of pairs whose symbols are numbered at once: some 30 MB.
_POINTS = 12_000_000
_BYTES = 16_000_000
_ONE = np.uint64(1)
_TOP = np.uint64(63)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _banded(pattern: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray, symbols: int, below: int, above: int) -> np.ndarray:
    """Of each row the cost of the best way whose diagonals (place in the text less place in the pattern) stay from -below to above, or a number between that and the distance. pattern, text: rows of symbols; m, n: how many of them count, m at most n, n at most m + above.

    Only the blocks of 64 places of the pattern that these diagonals pass are kept; beyond them costs grow by one a step,
    which is never too little. A block is one step behind the block before it, so each operation takes all blocks of all rows.
    """
    block = (m - 1) // 64
    ends = n - 1 + block  # the step at which the block with the pattern's end is at the text's end
    order = np.argsort(-ends, kind="stable")
    pattern, text, m, block, ends = pattern[order], np.ascontiguousarray(text[order].T), m[order], block[order], ends[order]
    steps = int(ends[0]) + 1
    text = np.concatenate([text, np.zeros((max(0, steps - len(text)), len(m)), text.dtype)])
    out, on, low, high, last = np.zeros(len(m), np.int64), len(m), 0, -1, int(block.max())
    rows, tables, slots, free = on, [], [], []
    plus, minus, score = (np.empty((0, rows), kind) for kind in (np.uint64, np.uint64, np.int64))
    up, down = np.ones((1, rows), np.uint64), np.zeros((1, rows), np.uint64)  # what each block passes on, after what comes in from above
    for t in range(steps):
        change = False
        while low < high and t > 65 * low + 63 + above:
            free.append(slots.pop(0))
            plus, minus, score, up, down = plus[1:], minus[1:], score[1:], up[1:], down[1:]
            up[0], down[0] = 1, 0
            low, change = low + 1, True
        if high < last and t >= max(high + 1, 65 * (high + 1) - below):
            high, change = high + 1, True
            if not free:
                free.append(len(tables))
                tables.append(None)
            table, base = np.zeros(on * symbols, np.uint64), np.arange(on) * symbols
            for i, column in enumerate(pattern[:on, 64 * high : 64 * high + 64].T):
                use = np.flatnonzero(m[:on] > 64 * high + i)
                table[base[use] + column[use]] |= _ONE << np.uint64(i)
            slots.append(free.pop())
            tables[slots[-1]] = table
            before = score[-1, :on] - up[-1, :on].view(np.int64) + down[-1, :on].view(np.int64) if high else 0
            plus, minus, score = (np.concatenate([x[:, :on], np.full((1, on), y, x.dtype)]) for x, y in ((plus, _ALL), (minus, 0), (score, 64)))
            score[-1] += before
            up, down = (np.concatenate([x[:, :on], np.zeros((1, on), np.uint64)]) for x in (up, down))
            rows = on
        if change:
            held = [tables[k] for k in slots]
            where = np.arange(rows) * symbols
            up_now, down_now = np.ones_like(up), np.zeros_like(down)
            eq = np.empty_like(plus)
        at = text[t - high : t - low + 1, :rows][::-1] + where
        for k, table in enumerate(held):
            table.take(at[k], out=eq[k], mode="clip")
        v = eq | minus
        eq |= down[:-1]
        h = eq & plus
        h += plus
        h ^= plus
        h |= eq
        hm = plus & h
        h |= plus
        hp = np.invert(h, out=h)
        hp |= minus
        np.right_shift(hp, _TOP, out=up_now[1:])
        np.right_shift(hm, _TOP, out=down_now[1:])
        hp <<= _ONE
        hm <<= _ONE
        hp |= up[:-1]
        hm |= down[:-1]
        np.bitwise_and(hp, v, out=minus)
        v |= hp
        np.invert(v, out=v)
        np.bitwise_or(hm, v, out=plus)
        up, up_now, down, down_now = up_now, up, down_now, down
        score += up[1:].view(np.int64)
        score -= down[1:].view(np.int64)
        if ends[on - 1] == t:
            begin = int(np.searchsorted(-ends[:on], -t))
            ended, of = np.arange(begin, on), block[begin:on] - low
            after = _ALL << ((m[begin:on] - 1) % 64).astype(np.uint64) << _ONE  # less what the places after the pattern add
            out[ended] = score[of, ended] + np.bitwise_count(minus[of, ended] & after) - np.bitwise_count(plus[of, ended] & after)
            on = begin
    result = np.empty_like(out)
    result[order] = out
    return result


def _within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, enough: np.ndarray, symbols: int, edits: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The distances of pairs of symbol sequences (the shorter first, none empty), or most + 1 where it is more, or some cost that is at most enough; how it is known, as in distances(); and those pairs that have too few of their length beside them, whose distance is left to others.

    Diagonals for so many edits are looked at first, and where they don't do for 4 times as many in turn.
    """
    m, n = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    out, unit, few, edits = most + 1, np.ones(len(pairs), np.int64), [], FIRST
    left = np.flatnonzero(n - m <= most)
    while len(left):
        ready = left[(n[left] - m[left] <= edits // 2) | (edits >= most[left]) | (n[left] <= _SHORT)]
        ready = ready[np.argsort(-n[ready], kind="stable")]
        at = 0
        while at < len(ready):
            longest = n[ready[at]]
            rows = max(1, min(4096, int(_BYTES // (8 * symbols * (2 + min(edits, longest) // 64) + 8 * longest))))
            part = ready[at : at + rows]
            part = part[(2 * n[part] >= longest) & ((n[part] <= _SHORT) == (longest <= _SHORT))]
            at += len(part)
            if len(part) < FEW_LONG and longest > CHARACTERS:
                few += part.tolist()
                continue
            filled = []
            for k, size in ((0, m[part]), (1, n[part])):
                block = np.zeros((len(part), int(size.max())), np.int32)
                block[np.arange(block.shape[1]) < size[:, None]] = np.concatenate([pairs[i][k] for i in part])
                filled.append(block)
            allowed, gap = np.where(n[part] <= _SHORT, most[part], np.minimum(edits, most[part])), n[part] - m[part]
            spare = (allowed - gap) // 2
            got = _banded(filled[0], m[part], filled[1], n[part], symbols, int(spare.max()), max(1, int((gap + spare).max())))
            known = got <= np.maximum(allowed, enough[part])
            out[part[known]], unit[part[known]] = got[known], np.where(got <= allowed, 0, 2)[known]
            done = known | (allowed >= most[part])
            left = np.setdiff1d(left, part[done], assume_unique=True)
        if few:
            left = np.setdiff1d(left, few)
        edits *= 4
    return out, unit, few


def _costs(x: list[str], y: list[str], most: np.ndarray, enough: np.ndarray, edits: int = FIRST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As _within, of pairs of texts."""
    ends = np.cumsum([len(a) + len(b) for a, b in zip(x, y, strict=True)])
    out, unit, few, at = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), [], 0
    while at < len(x):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _POINTS, "right")))
        both = [*x[at:stop], *y[at:stop]]
        points = np.frombuffer("".join(both).encode("utf-32-le", "surrogatepass"), np.uint32)
        times = np.bincount(points)
        there = np.flatnonzero(times)
        number = np.zeros(len(times), np.int32)
        number[there[np.argsort(-times[there], kind="stable")]] = np.arange(len(there))  # what comes often lies together
        parts = np.split(number[points], np.cumsum([len(t) for t in both])[:-1])
        pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(parts[: stop - at], parts[stop - at :], strict=True)]
        out[at:stop], unit[at:stop], alone = _within(pairs, most[at:stop], enough[at:stop], len(there), edits)
        few += [at + i for i in alone]
        at = stop
    return out, unit, few


def _eights(codes: np.ndarray, end: int) -> np.ndarray:
    """The 64 bits of symbols from each place on, ended by a symbol that the other text hasn't."""
    per = 8 // codes.itemsize
    padded = np.concatenate([codes, np.full(per, end, codes.dtype)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, per)).view(np.uint64).ravel()


def bounded_distance(x: str, y: str, most: int) -> int:
    """The distance of two texts, or most + 1 where it is more."""
    points = np.frombuffer((x + y).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, codes = np.unique(points, return_inverse=True)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if len(found) + 2 <= np.iinfo(t).max)
    m, n = len(x), len(y)
    gap = n - m
    surplus = np.bincount(codes[:m], minlength=len(found)) - np.bincount(codes[m:], minlength=len(found))
    if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > most:  # each edit mends one surplus of either side
        return most + 1
    codes = codes.astype(kind)
    a, b = _eights(codes[:m], len(found)), _eights(codes[m:], len(found) + 1)
    per, bits = 8 // codes.itemsize, np.uint64(8 * codes.itemsize)

    def extended(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        active = np.arange(len(i))
        while len(active):
            other = a[i[active]] ^ b[i[active] + k[active]]
            same = np.bitwise_count((other & -other) - _ONE) // bits if len(other) else other
            full = other == 0
            i[active] += np.where(full, per, same).astype(np.int64)
            active = active[full]
        return i

    zero, away = most + 1, -(1 << 40)
    reach = np.full(2 * most + 3, away)
    reach[zero] = extended(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for e in range(most + 1):
        if e:
            k = np.arange(max(-e, -m, gap - most + e), min(e, n, gap + most - e) + 1)
            at = k + zero
            i = np.minimum(np.maximum(np.maximum(reach[at], reach[at + 1]) + 1, reach[at - 1]), np.minimum(m, n - k))
            reach[at] = np.where(i >= 0, extended(np.maximum(i, np.maximum(0, -k)), k), away)
        if reach[gap + zero] >= m:
            return e
    return most + 1


def integer_distance(x: str, y: str, most: int) -> int:
    """The distance of two texts, or where it is more than most a number above most that it isn't less than."""
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return len(y)
    places: dict[str, int] = {}
    bit = 1
    for c in x:
        places[c] = places.get(c, 0) | bit
        bit <<= 1
    full, last = bit - 1, bit >> 1
    plus, minus, score = full, 0, len(x)
    for left, c in enumerate(y, 1 - len(y)):  # minus the characters that are left after this one
        equal = places.get(c, 0)
        same = (((equal & plus) + plus) ^ plus | equal | minus) & full
        up, down = minus | full ^ (same | plus), same & plus
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        if score + left > most:  # each of them takes off one at best
            return score + left
        up = up << 1 | 1
        plus, minus = (down << 1 | full ^ (same | up) & full) & full, up & same
    return score


def _alike_until(x: str, y: str) -> int:
    """How many characters two texts of one length have in common at their beginning, by halves."""
    low, high = 0, len(x)
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def without_common_ends(x: str, y: str) -> tuple[str, str]:
    shorter = min(len(x), len(y))
    first = _alike_until(x[:shorter], y[:shorter])
    x, y = x[first:], y[first:]
    shorter -= first
    last = _alike_until(x[len(x) - shorter :][::-1], y[len(y) - shorter :][::-1])
    return x[: len(x) - last], y[: len(y) - last]


def _characters(x: list[str], y: list[str]) -> np.ndarray:
    """The distances of pairs of texts, none empty."""
    most = np.array([max(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64)
    out, _, few = _costs(x, y, most, np.zeros(len(x), np.int64))
    for i in few:
        out[i] = integer_distance(x[i], y[i], int(most[i]))
    return out


def _pieces(x: str, y: str) -> list[tuple[str, str]]:
    """Two texts cut at places that look alike, about every PIECE characters: their distance is at most the sum of the pieces'."""
    out, i, j = [], 0, 0
    for at in range(PIECE, len(x) - _ANCHOR, PIECE):
        there = y.find(x[at : at + _ANCHOR], max(j, j + at - i - PIECE // 2), j + at - i + PIECE // 2)
        if there >= 0:
            out.append((x[i:at], y[j:there]))
            i, j = at, there
    return [*out, (x[i:], y[j:])]


def _at_most(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Of each pair a cost that is the distance or more: that of its pieces."""
    pieces = [_pieces(a, b) for a, b in pairs]
    whose = np.repeat(np.arange(len(pairs)), [len(p) for p in pieces])
    cut = [without_common_ends(a, b) for p in pieces for a, b in p]
    cost = np.array([max(len(a), len(b)) for a, b in cut], np.int64)
    some = np.array([bool(a and b) and max(len(a), len(b)) <= 4 * PIECE for a, b in cut], bool)
    if some.any():
        at = np.flatnonzero(some)
        most = np.minimum(cost[at], FIRST)
        found, unit, few = _costs([cut[i][0] for i in at], [cut[i][1] for i in at], most, most)
        for k in few:
            found[k] = integer_distance(*cut[at[k]], int(most[k]))
            unit[k] = found[k] > most[k]
        cost[at] = np.where(unit == 1, cost[at], found)
    return np.bincount(whose, cost, len(pairs)).astype(np.int64)


def distances(x: list[str], y: list[str], percent: int, beyond: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts (none empty) the distance, the longer one's length, and how the distance is known: 0 exactly, 1 only that it is that or more, which is too much for percent, 2 only that it is that or less, which percent allows.

    What is too much is told up to `beyond` times what percent allows (beyond INTEGERS characters, where few pairs come,
    once), twice by default, so that with a third text that is alike to one of the pair the triangle inequality says that
    it isn't alike to the other.
    """
    size = np.array([max(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64)
    cut = [without_common_ends(a, b) for a, b in zip(x, y, strict=True)]
    longer = np.array([max(len(a), len(b)) for a, b in cut], np.int64)
    open_ = np.array([bool(a and b) for a, b in cut], bool)
    out, unit, most = longer.copy(), np.zeros(len(x), np.int64), (100 - percent) * size // 100
    long = np.flatnonzero(open_ & (longer > (2 if beyond > 1 else 16) * PIECE))  # few are alike of those that are asked once
    if len(long):
        cost = _at_most([cut[i] for i in long])
        done = cost <= most[long]
        out[long[done]], unit[long[done]], open_[long[done]] = cost[done], 2, False
    batch, alone = np.flatnonzero(open_ & (longer <= INTEGERS)), np.flatnonzero(open_).tolist()
    if len(batch) >= FEW:
        enough = np.where(longer[batch] > CHARACTERS, most[batch], 0)
        out[batch], unit[batch], few = _costs([cut[i][0] for i in batch], [cut[i][1] for i in batch], beyond * most[batch], enough, FIRST if beyond > 1 else 4 * FIRST)
        alone = [*np.flatnonzero(open_ & (longer > INTEGERS)).tolist(), *batch[few].tolist()]
    for i in alone:
        (a, b), within = cut[i], int(most[i])
        if longer[i] <= INTEGERS:
            within *= beyond
            out[i] = integer_distance(a, b, within)
        else:
            out[i] = bounded_distance(a, b, within) if abs(len(a) - len(b)) <= within else within + 1
        unit[i] = out[i] > within
    return out, size, unit


def are_alike(x: str, y: str, percent: int) -> bool:
    """Of one pair, what alike() says."""
    longer = max(len(x), len(y))
    most = (100 - percent) * longer // 100
    if longer - min(len(x), len(y)) > most:
        return False
    x, y = without_common_ends(x, y)
    return (integer_distance if max(len(x), len(y)) <= INTEGERS else bounded_distance)(x, y, most) <= most


def alike(x: list[str], y: list[str], percent: int) -> np.ndarray:
    """Of each pair, whether the distance is at most (100 - percent) % of the longer one."""
    distance, longer, _ = distances(x, y, percent, beyond=1)
    return 100 * distance <= (100 - percent) * longer
