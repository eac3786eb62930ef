"""Five-word shingles of many texts at once, in numpy.

Texts come normalised: words with single spaces between them.  A shingle is then
the stretch of bytes from its first word to its last, and its hash is a
difference of two prefix sums of a polynomial over the bytes, so that no word is
ever made into a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes and texts that are shingled together; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 1 << 15
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_HASH_BITS = _U(48)
_HASH_MASK = _U((1 << 48) - 1)
_OF_BYTE = np.random.default_rng(1).integers(1, 2**63, 256).astype(_U)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0..n of ``base`` modulo 2**64; tables for one chunk are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        known = np.full(n + 1, base, _U)
        known[0] = 1
        known = np.cumprod(known, dtype=_U)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[: n + 1]


class ShingleSets:
    """Shingle hashes (48 bits) of consecutive texts, sorted within each text, with their counts.

    ``starts[d]`` to ``starts[d + 1]`` are those of text ``d``.  A text of fewer
    words than a shingle has is one shingle; one without words has none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        data, off = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        filled = off[1:] > off[:-1]
        spaces = np.flatnonzero(data == 32)
        begin = np.sort(np.concatenate([off[:-1][filled], spaces + 1]))
        end = np.sort(np.concatenate([off[1:][filled], spaces]))
        before = np.searchsorted(begin, off)
        words = np.diff(before)
        per_text = np.where(words > 0, np.maximum(1, words - SHINGLE + 1), 0)
        text = np.repeat(np.arange(n), per_text)
        first = before[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        last = first + np.minimum(SHINGLE, words[text]) - 1
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_OF_BYTE[data] * _powers(_BASE, len(data))[:-1], out=sums[1:])
        at = begin[first]
        h = mix((sums[end[last]] - sums[at]) * _powers(pow(_BASE, -1, 1 << 64), len(data))[at])
        keys = (text.astype(_U) << _HASH_BITS) | (h >> _U(16))
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        self.items = keys[new] & _HASH_MASK
        self.counts = np.diff(np.append(new, len(keys)))
        self.owner = (keys[new] >> _HASH_BITS).astype(np.int64)
        self.starts = np.searchsorted(self.owner, np.arange(n + 1))
        self.weight = per_text.astype(np.int64)

    def of(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of one text, and their counts."""
        part = slice(self.starts[text], self.starts[text + 1])
        return self.items[part], self.counts[part]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, ShingleSets]]:
    """(number of the first text, sets) of chunks of an Arrow column of normal texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        upto = min(max(upto, at + 1), at + CHUNK_TEXTS, len(texts))
        yield at, ShingleSets(data, offsets[at : upto + 1])
        at = upto


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of sorted items with counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def similarities(head: tuple[np.ndarray, np.ndarray], sets: ShingleSets, texts: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of ``head`` with the given ``texts`` of ``sets``."""
    sizes = sets.starts[texts + 1] - sets.starts[texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    part = np.arange(len(owner)) + np.repeat(sets.starts[texts] - (np.cumsum(sizes) - sizes), sizes)
    items, total = sets.items[part], float(head[1].sum())
    if not len(head[0]):
        return np.zeros(len(texts))
    place = np.minimum(np.searchsorted(head[0], items), len(head[0]) - 1)
    common = np.where(head[0][place] == items, np.minimum(head[1][place], sets.counts[part]), 0)
    both = np.bincount(owner, common, len(texts))
    union = total + sets.weight[texts] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)
