"""What text metrics count, over the code points of many texts at once: each text is read once, whatever is counted in it."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Kinds of characters, as bits. WORD: letters, numbers and marks, but no enclosing ones. EDGE: outer punctuation of a token.
SPACE, BREAK, SMALL, LATIN, CONSONANT, DEVANAGARI, DIGIT, PUNCTUATION, OTHER, CONTROL, REPLACEMENT, WORD, EDGE, LOWER, UPPER = (1 << k for k in range(15))
EDGES = ".,;:!?()[]{}\"'`—–-"
COUNTS = ["chars", "total", "tokens", "lines", "filled", "devanagari", "latin", "digits", "punctuation", "other", "control", "replacement", "stopwords", "alpha", "vowelless", "symbolic", "switched", "judged", "legacy"]


@lru_cache(1)
def kinds() -> np.ndarray:
    """The bits of each code point."""
    category = [unicodedata.category(chr(c)) for c in range(0x110000)]
    table = np.zeros(0x110000, np.uint16)
    for first, bits in (("C", OTHER), ("P", PUNCTUATION), ("L", WORD), ("N", WORD)):
        table[[c[0] == first for c in category]] |= bits
    for kind, bits in (("Mn", WORD), ("Mc", WORD), ("Nd", DIGIT), ("Ll", LOWER), ("Lu", UPPER)):
        table[[c == kind for c in category]] |= bits
    spaces = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] |= SPACE
    table[spaces] &= ~np.uint16(OTHER)
    table[[0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]] |= BREAK
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= LATIN
    table[[ord(c) for c in "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"]] |= CONSONANT
    table[[*range(0x900, 0x980), *range(0xA8E0, 0xA900)]] |= DEVANAGARI
    table[[*range(0x00, 0x09), *range(0x0E, 0x20)]] |= CONTROL
    table[0xFFFD] |= REPLACEMENT
    table[[ord(c) for c in EDGES]] |= EDGE
    return table


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many of the flags come before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of a flag."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _code(words: list[str]) -> np.ndarray:
    return np.array(sorted(sum((ord(c) & 31) << (5 * k) for k, c in enumerate(w)) for w in words), np.int64)


def _stopwords(points: np.ndarray, start: np.ndarray, length: np.ndarray, words: list[str]) -> np.ndarray:
    """Which tokens of Latin letters are one of the words (of twelve letters at most), in whatever case."""
    longest = max(map(len, words))
    some = np.flatnonzero(length <= longest)
    code = np.zeros(len(some), np.int64)
    for k in range(longest):
        more = length[some] > k
        code[more] |= (points[start[some[more]] + k].astype(np.int64) & 31) << (5 * k)
    return some[np.isin(code, _code(words))]


def _symbolic(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which tokens have, after their first sign that isn't outer punctuation, a sign of no word with something else than outer punctuation behind it."""
    first, last = _runs((kind & EDGE) != 0)
    inner, outer = start.copy(), end - 1
    for at, to, by in ((start, inner, last), (end - 1, outer, first - 1)):
        edge = np.flatnonzero((kind[at] & EDGE) != 0)
        to[edge] = by[np.searchsorted(first, at[edge], "right") - 1]
    odd = np.flatnonzero((kind & (WORD | SPACE)) == 0)
    after = np.append(odd, len(kind))[np.searchsorted(odd, inner, "right")]
    return (inner < end) & (after < end) & (outer > after)


def measure(texts: list[str], stopwords: list[str], *, line_tokens: int, vowelless: float, symbol: float, case_switch: float, devanagari: float, latin: float) -> dict[str, np.ndarray]:
    """COUNTS for each text. A line of `line_tokens` tokens or more is judged; it is legacy if a share of odd tokens exceeds its limit
    while its letters are Latin enough. Memory is some tens of bytes for each character of the texts."""
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    kind = kinds()[points]
    present = int(np.bitwise_or.reduce(kind))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    docs, end = begin[:-1], begin[1:] - 1

    stops = np.flatnonzero((kind & BREAK) != 0)
    stops = stops[~((points[stops] == 0x0D) & (points[stops + 1] == 0x0A))] + 1
    rows = np.union1d(docs[sizes > 0], stops[~np.isin(stops, end)])
    line_ends = np.append(rows, len(points))
    by_doc = np.searchsorted(rows, begin)

    def per(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(sums[bounds])

    def counted(bit: int) -> tuple[np.ndarray, np.ndarray]:
        """How often a kind occurs in each text and in each line."""
        if not present & bit:
            return np.zeros(len(docs), np.int64), np.zeros(len(rows), np.int64)
        sums = _sums((kind & bit) != 0)
        return per(sums, begin), per(sums, line_ends)

    out = {"chars": sizes, "lines": np.diff(by_doc)}
    for name, bit in (("digits", DIGIT), ("punctuation", PUNCTUATION), ("other", OTHER), ("control", CONTROL), ("replacement", REPLACEMENT)):
        out[name] = counted(bit)[0]
    out["devanagari"], line_devanagari = counted(DEVANAGARI)

    solid = (kind & SPACE) == 0
    sums = _sums(solid)
    out["total"], line_total = per(sums, begin), per(sums, line_ends)
    first, last = _runs(solid)
    length = last - first
    token_docs, token_lines = np.searchsorted(first, begin), np.searchsorted(first, line_ends)
    sums = _sums((kind & LATIN) != 0)
    out["latin"], line_latin = per(sums, begin), per(sums, line_ends)
    lettered = sums[last] - sums[first] == length
    sums = _sums((kind & CONSONANT) != 0)
    odd = {"alpha": lettered & (length >= 3), "vowelless": (sums[last] - sums[first] == length) & (length >= 3), "symbolic": _symbolic(kind, first, last), "switched": np.zeros(len(first), bool), "stopwords": np.zeros(len(first), bool)}
    turns = np.flatnonzero(((kind[:-1] & LOWER) != 0) & ((kind[1:] & UPPER) != 0))
    odd["switched"][np.searchsorted(first, turns, "right") - 1] = True
    letters = np.flatnonzero(lettered)
    odd["stopwords"][letters[_stopwords(points, first[letters], length[letters], stopwords)]] = True
    lines = {}
    for name, flags in odd.items():
        sums = _sums(flags)
        out[name], lines[name] = per(sums, token_docs), per(sums, token_lines)
    out["tokens"], tokens = np.diff(token_docs), np.diff(token_lines)

    share = lambda name, whole: np.round(lines[name] / np.maximum(whole, 1), 9)
    shape = (share("vowelless", lines["alpha"]) > vowelless) | (share("symbolic", tokens) > symbol) | (share("switched", tokens) > case_switch)
    judged = tokens >= line_tokens
    legacy = judged & shape & ~((line_devanagari > devanagari * line_total) | (line_latin < latin * line_total))
    out |= {name: per(_sums(flags), by_doc) for name, flags in (("filled", line_total > 0), ("judged", judged), ("legacy", legacy))}
    return out
