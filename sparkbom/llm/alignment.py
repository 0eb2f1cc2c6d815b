"""Words of a text without mark-up, and the best local alignment of two word lists (small per-pair helpers)."""

from __future__ import annotations

import re

import numpy as np

_TAG = re.compile(r"<[^<>\n]{0,200}>|&(?:[a-z]+|#\d+);")
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-case words in order; mark-up, punctuation and line breaks are left out."""
    return [w for x in _WORD.findall(_TAG.sub(" ", text or "").lower()) if (w := x.strip("_"))]


def best_overlap(a: list[int], b: list[int], error: float = 3.0) -> tuple[int, int]:
    """(words of b that the best local alignment spans, words that agree). Each agreement scores 1, each changed, dropped or
    inserted word costs ``error``: a longest common subsequence that only occasional differences may interrupt."""
    # one row per word of a; cells hold (score, agreements, start in b)
    prev = [(0.0, 0, j) for j in range(len(b) + 1)]
    best = (0.0, 0, 0)
    for x in a:
        row = [(0.0, 0, 0)]
        left = row[0]
        diagonal = prev[0]
        for j, y in enumerate(b, 1):
            up = prev[j]
            if x == y:
                cell = (diagonal[0] + 1, diagonal[1] + 1, diagonal[2] if diagonal[0] > 0 else j - 1)
            else:
                cell = diagonal if diagonal[0] >= up[0] and diagonal[0] >= left[0] else up if up[0] >= left[0] else left
                cell = (cell[0] - error, cell[1], cell[2])
                if cell[0] <= 0:
                    cell = (0.0, 0, j)
            row.append(cell)
            left, diagonal = cell, up
            if cell[0] > best[0]:
                best = (cell[0], j - cell[2], cell[1])
        prev = row
    return best[1], best[2]


def window(a: list[int], b: list[int], least: int, edits: int) -> tuple[int, int]:
    """(words of b that a window spans, words that agree): the first window of at least ``least`` words of b, else the longest,
    that stands in a with at most ``edits`` changed, dropped or inserted words wherever they lie between its first and its
    last word, which agree. From the start of each run of agreeing words the furthest reach is followed edit by edit."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    best = (0, 0)
    for j in range(len(b) - least + 1):
        for i in at.get(b[j], ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # the run began earlier and reaches as far
            front = {i - j: (i, 0)}
            for _ in range(edits + 1):
                step: dict[int, tuple[int, int]] = {}
                for d, (x, n) in front.items():
                    end = x
                    while end < len(a) and end - d < len(b) and a[end] == b[end - d]:
                        end += 1
                    n += end - x
                    if end > x and end - d - j > best[0]:
                        best = (end - d - j, n)
                    for diagonal, to in ((d, end + 1), (d + 1, end + 1), (d - 1, end)):
                        if to <= len(a) and to - diagonal <= len(b) and (diagonal not in step or step[diagonal][0] < to):
                            step[diagonal] = (to, n)
                if best[0] >= least:
                    return best
                front = step
    return best


def differences(a: list[int], b: list[int]) -> int:
    """Fewest changed, dropped or inserted words with which the whole of b stands somewhere in a."""
    prev = list(range(len(b) + 1))
    least = prev[-1]
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[-1] + 1))
        prev = row
        least = min(least, row[-1])
    return least


def least_pairs(least: int, error: float = 3.0) -> tuple[int, int]:
    """(pairs, diagonals): of any alignment that spans ``least`` words at ``error`` per difference, a part spans just that many
    words. With k differences it has max(least - k, error * k + 1) agreements in k + 1 runs, so at least so many pairs of agreeing
    neighbours, on diagonals no further than k apart."""
    ways = [k for k in range(least) if error * k + 1 <= least]
    return int(min(max(least - k, error * k + 1) - (k + 1) for k in ways)), ways[-1]


def may_overlap(a: np.ndarray, b: np.ndarray, least: int, error: float = 3.0) -> bool:
    """Whether some ``least`` words of b hold enough agreeing pairs, on near diagonals, for :func:`best_overlap` or :func:`window` to
    span so many words."""
    pairs, apart = least_pairs(least, error)
    if pairs < 1:
        return True
    if len(a) < 2 or len(b) < 2:
        return False
    same = a[:, None] == b[None, :]
    i, j = np.nonzero(same[:-1, :-1] & same[1:, 1:])
    if len(i) < pairs:
        return False
    # counts per diagonal and place in b, summed over boxes of apart + 1 diagonals and least places
    diagonal = i - j + len(b)
    diagonal, width, height = diagonal - diagonal.min(), len(b) + least, int(diagonal.max() - diagonal.min()) + apart + 2
    grid = np.zeros((height, width), dtype=np.int32)
    grid[diagonal + apart + 1, j + least] = 1
    total = grid.cumsum(0).cumsum(1)
    rows = total[apart + 1 :] - total[: height - apart - 1]
    return bool((rows[:, least:] - rows[:, : width - least]).max() >= pairs)


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits: one addition per word of ``a``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for x in a:
        if m := where.get(x):
            hit = free & m
            free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()
