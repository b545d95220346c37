"""The rolling hash that finds chunk boundaries, its parameters, and digests."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

WINDOW = 48
MASK = 0xFFFFFFFF


def derived_table() -> tuple[int, ...]:
    """256 values of 32 bits, by a rule: the first four bytes of the SHA-256 digest of each byte.

    Boundaries agree with those of another program only if its table is given instead (see `read_table`).
    """
    return tuple(int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256))


def read_table(path: str) -> tuple[int, ...]:
    """A table from a text file of 256 hexadecimal numbers, separated by white space or commas."""
    with open(path) as f:
        values = tuple(int(x, 16) for x in f.read().replace(",", " ").split())
    if len(values) != 256 or max(values) > MASK:
        raise ValueError("a table has 256 values of 32 bits")
    return values


def discriminator(average: int) -> int:
    """The divisor that makes chunks of about `average` bytes; the two factors are fixed values."""
    return int(average / (-1.42888852e-7 * average + 1.33237515))


@dataclass(frozen=True)
class Sizes:
    """Smallest, average and largest chunk in bytes, the digest that names chunks, and the hash's table."""

    least: int = 16 << 10
    average: int = 64 << 10
    most: int = 256 << 10
    digest: str = "sha512_256"
    table: tuple[int, ...] = field(default_factory=derived_table, repr=False)

    def __post_init__(self):
        if self.least < WINDOW:
            raise ValueError(f"the smallest chunk size must be at least {WINDOW}")
        if not self.least <= self.average <= self.most:
            raise ValueError("sizes must rise: least, average, most")
        if self.digest not in ("sha512_256", "sha256"):
            raise ValueError("the digest is sha512_256 or sha256")

    @classmethod
    def parse(cls, text: str, **more) -> Sizes:
        """From min:avg:max in KiB."""
        parts = text.split(":")
        if len(parts) != 3:
            raise ValueError("sizes are given as min:avg:max")
        return cls(*(int(p) << 10 for p in parts), **more)

    @property
    def divisor(self) -> int:
        return discriminator(self.average)


def digest(data: bytes, name: str = "sha512_256") -> str:
    return hashlib.new(name, data).hexdigest()


def rotated(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values of 32 bits, rotated left."""
    return (values << by | values >> ((32 - by) & 31)).astype(np.uint32)


def candidates(data: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Places (last byte of a possible chunk) where the hash of the 48 bytes up to it meets the test.

    Rotation distributes over xor, so the window's hash is the xor of two running xors of table values rotated
    by their place, rotated back: one pass, and no state but the last 48 bytes.
    """
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    turn = (np.arange(len(data)) & 31).astype(np.uint32)
    run = np.bitwise_xor.accumulate(rotated(np.array(sizes.table, np.uint32)[data], (32 - turn) & np.uint32(31)))
    window = run[WINDOW - 1 :].copy()
    window[1:] ^= run[:-WINDOW]
    h = rotated(window, turn[WINDOW - 1 :])
    return np.flatnonzero(h % np.uint32(sizes.divisor) == sizes.divisor - 1) + (WINDOW - 1)


def cut(size: int, places: list[int], sizes: Sizes) -> list[int]:
    """Ends of the chunks of a blob of `size` bytes, from its candidates in order.

    A rest of at most `least` bytes is one chunk. Else a chunk ends at the first candidate that makes it longer
    than `least`, or after `most` bytes.
    """
    from bisect import bisect_left

    ends, start = [], 0
    while start < size:
        if size - start <= sizes.least:
            end = size
        else:
            k = bisect_left(places, start + sizes.least)
            end = min(size, start + sizes.most, *(p + 1 for p in places[k : k + 1]))
        ends.append(end)
        start = end
    return ends
