"""Indel similarity of many pairs of strings at once, in numpy: one lane of 64-bit words a pair.

Every lane takes the same bit-parallel step for its own next character, so that a batch costs as many steps as its longest
string has characters, not as many loops as it has pairs.  Lanes of like length go together; strings of more than 64
characters chain words by their carries, and those beyond LONG characters, for which lanes would be mostly padding, use
integers of any length.
"""

from __future__ import annotations

import numpy as np

LONG = 512
#: Cells of a block's table of equal characters.
BLOCK = 1 << 17


class Codes:
    """Strings as one array of code points."""

    def __init__(self, strings: list[str]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(code: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, pad: int) -> np.ndarray:
    at = np.arange(width)
    held = at < size[:, None]
    out = np.full((len(start), width), pad, np.uint32)
    out[held] = code[(start[:, None] + at)[held]]
    return out


def _block(a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Common subsequences of padded rows; b's width is a multiple of 64 for more than one word, or 8, 16, 32 or 64."""
    n, width = b.shape
    words = max(1, width // 64)
    full = np.zeros((n, words), np.uint64)
    for w in range(words):
        bits = np.clip(size_b - 64 * w, 0, 64)
        full[:, w] = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
    s = full.copy()
    packed = np.zeros((n, words * 8), np.uint8)
    for i in range(a.shape[1]):
        packed[:, : width // 8] = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little")
        m = packed.view(np.uint64)
        if words == 1:
            hit = s & m
            s = (s + hit) | (s - hit)
            continue
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            hit = s[:, w] & m[:, w]
            one = s[:, w] + hit
            two = one + carry
            carry = ((one < hit) | (two < one)).astype(np.uint64)
            s[:, w] = two | (s[:, w] - hit)
    return np.bitwise_count(~s & full).sum(axis=1).astype(np.int64)


def _any_length(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    s = full
    for c in a:
        hit = s & masks.get(c, 0)
        s = (s + hit) | (s - hit)
    return (~s & full).bit_count()


def common(code: np.ndarray, start_a: np.ndarray, size_a: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each two runs of code points."""
    out = np.zeros(len(size_a), np.int64)
    swap = size_a > size_b  # steps are taken over a, lanes hold b: the longer one stands in the lane
    start_a, start_b = np.where(swap, start_b, start_a), np.where(swap, start_a, start_b)
    size_a, size_b = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    text = lambda at, n: code[at : at + n].tobytes().decode("utf-32-le", "surrogatepass")
    for i in np.flatnonzero(size_b > LONG):
        out[i] = _any_length(text(start_a[i], size_a[i]), text(start_b[i], size_b[i]))
    lanes = np.flatnonzero((size_a > 0) & (size_b <= LONG))
    width = np.where(size_b <= 64, np.maximum(8, 1 << np.ceil(np.log2(np.maximum(size_b, 1))).astype(np.int64)), -(-size_b // 64) * 64)
    lanes = lanes[np.lexsort((size_a[lanes], width[lanes]))]
    at = 0
    while at < len(lanes):
        wide = int(width[lanes[at]])
        end = min(at + max(1, BLOCK // wide), int(np.searchsorted(width[lanes], wide, "right")))
        own = lanes[at:end]
        a = _padded(code, start_a[own], size_a[own], int(size_a[own].max()), 0xFFFFFFFF)
        b = _padded(code, start_b[own], size_b[own], wide, 0xFFFFFFFE)
        out[own] = _block(a, b, size_b[own])
        at = end
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """200 * common / (len a + len b) of each pair, 100 for two empty strings."""
    both = Codes([*a, *b])
    n = len(a)
    total = both.size[:n] + both.size[n:]
    found = common(both.code, both.start[:n], both.size[:n], both.start[n:], both.size[n:])
    return np.where(total == 0, 100.0, 200.0 * found / np.maximum(total, 1))


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of each pair's shorter string with a window of its length of the longer one, or with a shorter end
    of it; 0 if one is empty, 100 if both are."""
    both = Codes([*a, *b])
    n = len(a)
    short = np.where(both.size[:n] <= both.size[n:], np.arange(n), np.arange(n) + n)
    long_ = np.where(both.size[:n] <= both.size[n:], np.arange(n) + n, np.arange(n))
    ls, ll = both.size[short], both.size[long_]
    out = np.where((ls == 0) & (ll == 0), 100.0, 0.0)
    live = np.flatnonzero(ls > 0)
    windows = ls[live] + ll[live] - 1
    step = 0
    while step < len(live):  # blocks of pairs of bounded windows
        end = step + max(1, int(np.searchsorted(np.cumsum(windows[step:]), 200_000)))
        own, n_w = live[step:end], windows[step:end]
        pair = np.repeat(own, n_w)
        first = np.repeat(np.cumsum(n_w) - n_w, n_w)
        i = np.arange(len(pair)) - first - ls[pair] + 1
        x, y = np.maximum(i, 0), np.minimum(i + ls[pair], ll[pair])
        found = common(both.code, both.start[short[pair]], ls[pair], both.start[long_[pair]] + x, y - x)
        score = 200.0 * found / (ls[pair] + y - x)
        out[own] = np.maximum.reduceat(score, np.cumsum(n_w) - n_w)
        step = end
    return out


def composites(a: list[str], b: list[str]) -> np.ndarray:
    """The usual composite scorer, by its published description: the best of the plain ratio, 0.95 of that of sorted or
    common words, and, where one string is at least half longer, of the best part of it (0.9, or 0.6 from eight times the
    length on); 0 where either is empty.  Only the sets of words are made pair by pair; all scores are lanes'."""
    words = {s: (sorted(s.split()), set(s.split())) for s in {*a, *b}}
    joined = lambda x: " ".join(sorted(x))
    n = len(a)
    both = [joined(words[x][1] & words[y][1]) for x, y in zip(a, b)]
    only_a, only_b = ([joined(words[x][1] - words[y][1]) for x, y in zip(*p)] for p in ((a, b), (b, a)))
    sorted_a, sorted_b = ([" ".join(words[x][0]) for x in s] for s in (a, b))
    la, lb = (np.fromiter(map(len, s), np.int64, n) for s in (a, b))
    some = (la > 0) & (lb > 0)
    longer = np.maximum(la, lb) / np.maximum(1, np.minimum(la, lb))
    near = some & (longer < 1.5)
    shared = np.fromiter(map(bool, both), bool, n)

    def at(which: np.ndarray, score, x: list[str], y: list[str]) -> np.ndarray:
        """Scores of those pairs, 0 of others."""
        out, own = np.zeros(n), np.flatnonzero(which)
        if len(own):
            out[own] = score([x[i] for i in own], [y[i] for i in own])
        return out

    with_a, with_b = ([f"{s} {t}".strip() for s, t in zip(both, only)] for only in (only_a, only_b))
    inner = np.fromiter((not x or not y for x, y in zip(only_a, only_b)), bool, n)
    token = at(near, ratios, sorted_a, sorted_b)
    parts = np.maximum.reduce([at(near & shared & ~inner, ratios, x, y) for x, y in ((both, with_a), (both, with_b), (with_a, with_b))])
    token = np.maximum(token, np.where(shared & inner, 100.0, parts))
    far = some & ~near
    share = np.where(longer < 8, 0.9, 0.6)
    part = at(far, partial_ratios, a, b)
    words_part = np.where(shared, 100.0, np.maximum(at(far & ~shared, partial_ratios, sorted_a, sorted_b), at(far & ~shared, partial_ratios, only_a, only_b)))
    score = np.maximum(at(some, ratios, a, b), np.where(near, 0.95 * token, np.maximum(share * part, 0.95 * share * words_part)))
    return np.where(some, score, 0.0)
