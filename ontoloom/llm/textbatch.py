"""Words and hashes of a batch of texts, by numpy over the concatenated UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, and an odd base with its inverse modulo 2^64.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) | 5
INVERSE = pow(BASE, -1, 1 << 64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def texts_of(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "replace") if x else b"" for x in column.to_pylist()]


def slices(batch, column: int, rows: int = 200, size: int = 1 << 20):
    """batch in parts of at most `rows` rows and about `size` bytes of the column (one row at least), so that hashing a part takes little memory."""
    lengths = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and (k - start >= rows or total + n > size):
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)
    tidy()


def tidy() -> None:
    """Gives memory that the last batch has left free back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data))[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(data))[starts])


class Words:
    """Of texts, lower-cased in A-Z: hash of each word between white space, and the words of text k as hash[at[k]:at[k + 1]]."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = FOLD[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        self.ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        word = np.concatenate([[False], ~SPACE[self.data], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.stops = edge[::2], edge[1::2]
        self.hash = hash_spans(self.data, self.starts, self.stops)
        self.at = np.concatenate([[0], np.searchsorted(self.starts, self.ends)]).astype(np.int64)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words has its whole sequence as one, one without words none."""
    w = Words(texts)
    n = len(w.hash)
    roll = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        roll[: max(0, n - k)] = roll[: max(0, n - k)] * U(0x9E3779B97F4A7C15) + w.hash[k:]
    roll, out = mix(roll), []
    for a, b in zip(w.at[:-1], w.at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        else:
            h = U(b - a)
            for x in w.hash[a:b]:
                h = mix(np.array([h], dtype=np.uint64))[0] ^ x
            out.append(np.array([h][: int(b > a)], dtype=np.uint64))
    return out
