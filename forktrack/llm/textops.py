"""Vectorised text primitives: code points in numpy arrays, token spans and 64-bit span hashes.

Texts are handled in chunks of bounded size; a long text is cut only before white space that follows
something else, where neither a word nor a pre-token can span the cut.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 0, 4
SENTINEL = 0x110000
_SENTINEL = np.array([SENTINEL], "<u4").tobytes()
CHUNK = 1 << 18
_CUT = re.compile(r"(?<=\S)\s")

U64 = np.uint64
#: Odd multipliers of the two polynomial span hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, by the Unicode properties that the pre-token pattern names."""
    points = np.r_[0:0xD800, 0xE000:SENTINEL]
    chars = "".join(map(chr, points.tolist()))
    kinds = np.zeros(len(points), np.uint8)
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(prop, chars):
            kinds[m.start():m.end()] = kind
    table = np.zeros(SENTINEL + 1, np.uint8)
    table[points] = kinds
    table[SENTINEL] = END
    return table


@functools.cache
def _in_words() -> np.ndarray:
    """Whether words have each code point."""
    return (classes() == LETTER) | (classes() == NUMBER)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash, on a new array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of an array in order: by sorting, which is many times faster here than by hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        m = _CUT.search(text, at + CHUNK)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def chunks(texts: list[str | None], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points with a sentinel after each segment, starts of segments, text index of each); null is empty."""
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush():
        cp = np.frombuffer(_SENTINEL.join(held) + _SENTINEL, "<u4")
        lengths = np.fromiter((len(b) // 4 + 1 for b in held), np.int64, len(held))
        return cp, np.cumsum(lengths) - lengths, np.array(owner, np.int64)

    for i, text in enumerate(texts):
        for part in _segments(text or ""):
            part = part.lower() if lower else part
            held.append(part.encode("utf-32-le", "surrogatepass"))
            owner.append(i)
            size += len(part)
            if size >= CHUNK:
                yield flush()
                held, owner, size = [], [], 0
    if held:
        yield flush()


def owners(starts: np.ndarray, seg_starts: np.ndarray, seg_owner: np.ndarray) -> np.ndarray:
    """Text index of each span."""
    return seg_owner[np.searchsorted(seg_starts, starts, "right") - 1]


def words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of letters and numbers."""
    inside = np.zeros(len(cp) + 2, bool)
    np.take(_in_words(), cp, out=inside[1:-1], mode="clip")
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def pretokens(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the public pre-token pattern.

    A token starts where the class changes; the last white-space character before other text stands alone,
    or, a plain space, joins what follows; an apostrophe that no space precedes takes a contraction's letters.
    """
    kind = classes()[cp]
    n = len(cp)
    begin = np.empty(n + 1, bool)
    begin[0] = True
    begin[1:n] = kind[1:] != kind[:-1]
    begin[n] = True
    end = np.flatnonzero(kind == END)
    begin[end] = True
    begin[end + 1] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    begin[last] = True
    begin[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero((cp == 0x27) & begin[:n])
    if len(quote):
        one, two = cp[np.minimum(quote + 1, n - 1)], cp[np.minimum(quote + 2, n - 1)]
        single = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, more in ((quote[single], 1), (quote[double], 2)):
            begin[at + 1] = False
            begin[at + 1 + more] = True
    starts = np.flatnonzero(begin[:n])
    ends = np.append(starts[1:], n)
    keep = kind[starts] != END
    return starts[keep], ends[keep]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(base)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, CHUNK * 2)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p))
        held = (both[0], both[1])
        if size <= CHUNK * 4:
            _POWERS[base] = held
    return held


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """64-bit hash of each span's characters, wherever it stands: prefix sums of a polynomial, shifted back."""
    power, inverse = _powers(base, len(cp))
    total = np.zeros(len(cp) + 1, U64)
    np.cumsum((cp.astype(U64) + U64(1)) * power[: len(cp)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of all texts in order, and where each text's words start (len + 1 bounds)."""
    hashes, counts = [np.zeros(0, U64)], np.zeros(len(texts) + 1, np.int64)
    for cp, seg, owner in chunks(texts, lower=True):
        s, e = words(cp)
        hashes.append(span_hashes(cp, s, e))
        counts[1:] += np.bincount(owners(s, seg, owner), minlength=len(texts))
    return np.concatenate(hashes), np.cumsum(counts)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of several hashes, order included."""
    out = np.full(len(parts[0]), 0x243F6A8885A308D3, U64)
    for p in parts:
        out = mix64(out * U64(BASE_A) + p)
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``width`` words; a text of fewer words, but some, is one shingle."""
    n = np.diff(bounds)
    texts = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - bounds[texts]
    full = place + width <= n[texts]
    at = np.flatnonzero(full)
    out = combine([hashes[at + k] for k in range(width)]) if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        rest = np.array([combine([np.r_[U64(n[i]), hashes[bounds[i]:bounds[i + 1]]][[j]] for j in range(n[i] + 1)])[0] for i in short], U64)
        owner = np.r_[texts[at], short]
        order = np.argsort(owner, kind="stable")
        return owner[order], np.r_[out, rest][order]
    return texts[at], out
