"""Edit distance of sequences of any symbols, a column of the table at a time in the bits of one integer."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least number of inserted, deleted and replaced symbols (Levenshtein), by bit-parallel recurrences of Myers (1999)
    and, within a band, Hyyro (2003).

    A bit of up (down) says that the distance table rises (falls) by one from the row before to its own, in the current
    column; a step for each symbol of b updates all rows at once. Integers have as many bits as the band has rows, and
    symbols are looked up in a dictionary, so neither lengths nor alphabets are bounded. A distance of at most t needs no
    more than the t diagonals on either side, so bands are widened until the distance fits; like sequences are quick.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    places: dict[Hashable, list[int]] = {}
    for i, symbol in enumerate(a):
        places.setdefault(symbol, []).append(i)
    wanted = set(b)
    where = {}
    for symbol, at in places.items():
        if symbol in wanted:
            bits = bytearray(len(a) // 8 + 1)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            where[symbol] = int.from_bytes(bits, "little")
    band = max(64, 2 * abs(len(a) - len(b)))
    while band < len(a) // 2:
        distance = _within(a, b, where, band)
        if distance <= band:
            return distance
        band *= 8
    return _whole(a, b, where)


def _whole(a: Sequence[Hashable], b: Sequence[Hashable], where: dict[Hashable, int]) -> int:
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = full, 0, len(a)
    for symbol in b:
        same = where.get(symbol, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        distance += (right_up >> last & 1) - (right_down >> last & 1)
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
    return distance


def _within(a: Sequence[Hashable], b: Sequence[Hashable], where: dict[Hashable, int], band: int) -> int:
    """The distance where it is at most band, else some larger number. Bit p of a column j stands for row j - band + p; the
    distance is followed down the band's last diagonal to the last row, and along that row to the end."""
    full, last = (1 << (2 * band + 1)) - 1, 2 * band
    up, down, distance = full >> band << band, 0, band
    for j, symbol in enumerate(b, 1):
        same, first = where.get(symbol, 0), j - band - 1
        same = (same >> first if first >= 0 else same << -first) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if j + band <= len(a):
            distance += not diagonal >> last & 1
        else:
            row = len(a) - j + band
            distance += (right_up >> row & 1) - (right_down >> row & 1)
        moved = diagonal >> 1
        up = right_down | ~(moved | right_up) & full
        down = moved & right_up
    return distance
