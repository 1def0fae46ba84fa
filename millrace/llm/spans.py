"""Texts as arrays of code points, and distinct spans of them, without a Python step per token."""

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Code points of spans that are summed and compared at a time, about.
_CHUNK = 1 << 18


def trimmed() -> None:
    """Give free memory of the C library back, where it has a call for that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches: Iterator, rows: int = 512) -> Iterator:
    """Each batch (or tuple of arrays) in slices, so that Python objects exist for a few rows at a time only; what a batch
    took of memory goes back to the system."""
    for batch in batches:
        many = isinstance(batch, tuple)
        size = len(batch[0]) if many else len(batch)
        for at in range(0, size, rows):
            yield tuple(b.slice(at, rows) for b in batch) if many else batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
        trimmed()


def ranges(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of together at most limit code points; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the bounds of each text among them."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), bounds


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _sums(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for codes[start:end] of each span, by differences of prefix sums. Equal spans have equal numbers, but
    spans with equal numbers may differ: only good for sorting spans before they are compared."""
    power, inverse = _powers(max(1 << 18, 1 << int(len(codes)).bit_length()))
    value = (codes.astype(U) + U(1)) * U(0xA24BAED4963EE407)
    value ^= value >> U(29)
    prefix = np.zeros(len(codes) + 1, U)
    np.cumsum(value * power[: len(codes)], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts])


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans codes[start:end], none empty, as UTF-32 bytes, and the number of each span among them.

    Spans are sorted by a number, then every span is compared, code point by code point, with the one that stands for
    its number; where any two differ, all are told apart by their bytes.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    codes = np.ascontiguousarray(codes, "<u4")
    length = ends - starts
    cuts = np.searchsorted(np.cumsum(length), np.arange(_CHUNK, int(length.sum()) + _CHUNK, _CHUNK), "left") + 1
    parts = [(a, b) for a, b in zip([0, *cuts[:-1].tolist()], np.minimum(cuts, len(starts)).tolist(), strict=True) if a < b]
    within = lambda a, b: (codes[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
    sums = np.concatenate([np.zeros(0, U), *[_sums(*within(a, b)) for a, b in parts]])
    _, one, inverse = np.unique(sums, return_index=True, return_inverse=True)
    stand = one[inverse]
    same = bool((length == length[stand]).all())
    for a, b in parts:
        if same:
            own = length[a:b]
            upto = np.cumsum(own)
            at = np.repeat(starts[a:b] - (upto - own), own) + np.arange(upto[-1])
            same = bool((codes[at] == codes[at + np.repeat(starts[stand[a:b]] - starts[a:b], own)]).all())
    raw = lambda s, e: codes[s:e].tobytes()
    if same:
        return [raw(s, e) for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], inverse
    numbers: dict[bytes, int] = {}
    every = [numbers.setdefault(raw(s, e), len(numbers)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return list(numbers), np.array(every, np.int64)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, chained: int = 32) -> np.ndarray:
    """A 64-bit hash of each span: every code point is mixed into the state that those before it left, so that no
    regularity of the text shows in it; of spans longer than `chained`, 64 bits of BLAKE2b."""
    length = ends - starts
    out = mixed(length.astype(U) * U(0xA24BAED4963EE407) + U(_BASE))
    short = np.flatnonzero(length <= chained)
    short = short[np.argsort(-length[short], kind="stable")]
    h, at, size = out[short], starts[short], -length[short]
    for k in range(int(-size[0]) if len(size) else 0):
        n = int(np.searchsorted(size, -k))
        h[:n] = mixed((h[:n] ^ codes[at[:n] + k]) * U(0x9E3779B97F4A7C15) + U(k))
    out[short] = h
    raw = np.ascontiguousarray(codes, "<u4")
    for i in np.flatnonzero(length > chained).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gathered(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows `which` of a ragged array with those offsets, one after another, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets[:-1][which] - (ends - lengths), lengths) + np.arange(total), lengths
