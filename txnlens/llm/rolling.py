"""Rolling hashes over whole arrays (numpy, unsigned 64-bit wrap-around arithmetic).

The hash of window ``i`` of width ``w`` is ``mix(sum v[i+j] * B**j for j < w)``: equal
windows have equal hashes wherever they stand, and all windows of an array cost a few
vector operations. Values must be well mixed (``mix64`` or a random table), since plain
small integers collide in polynomials modulo 2**64. Over long stretches some patterned
texts collide whatever the table is (the high powers of two in the sums vanish), so these
hashes only find what may be equal; what decides is ``digests`` of whole stretches, or
sums over no more than some ninety values.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U64 = np.uint64
#: Odd multipliers of the two independent polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**0 .. base**(n-1)`` and the same for its inverse, modulo 2**64 (kept per process)."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, dtype=U64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        held = _POWERS[base] = (tables[0], tables[1])
    return held[0][:n], held[1][:n]


class Rolling:
    """Prefix sums of one value array; ``spans`` hashes any stretches of it."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of each full window, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


#: Bytes of the longest word hashed eight at a time.
_LONG = 256


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each stretch of bytes."""
    view = memoryview(np.ascontiguousarray(data))
    joined = b"".join([blake2b(view[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(joined, dtype="<u8").copy()


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of hash of each word: eight bytes after eight, mixed in between; a digest of a very long one."""
    n = end - start
    out = mix64((n.astype(U64) + U64(1)) * U64(BASES[0]))
    eight = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, np.uint8)), (len(data) + 1, 8), (1, 1))
    live, at = np.flatnonzero(n <= _LONG), 0
    while len(live):
        left = n[live] - at
        chunk = eight[start[live] + at].view("<u8").reshape(-1)
        chunk &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * np.clip(left, 1, 8).astype(U64))
        out[live] = mix64((out[live] ^ chunk) * U64(BASES[1]) + U64(at + 1))
        live, at = live[left > 8], at + 8
    far = np.flatnonzero(n > _LONG)
    if len(far):
        out[far] = digests(data, start[far], end[far])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's BIGINT."""
    return x.view(np.int64)
