"""XChaCha20-Poly1305, as the IETF draft and RFC 8439 define it, with numpy over the blocks of a message."""

from __future__ import annotations

import hmac
import os

import numpy as np

SIGMA = np.frombuffer(b"expand 32-byte k", "<u4")


def rounds(state: np.ndarray) -> np.ndarray:
    """Twenty rounds over the last axis, 16 words a block."""
    x = [state[..., k].copy() for k in range(16)]

    def turned(v: np.ndarray, n: int) -> np.ndarray:
        return v << np.uint32(n) | v >> np.uint32(32 - n)

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[p] = x[p] + x[q]
            x[r] = turned(x[r] ^ x[p], n)

    for _ in range(10):
        for k in range(4):
            quarter(k, 4 + k, 8 + k, 12 + k)
        for k in range(4):
            quarter(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4)
    return np.stack(x, -1)


def stream(key: bytes, nonce: bytes, size: int, counter: int) -> bytes:
    n = (size + 63) // 64
    state = np.zeros((n, 16), np.uint32)
    state[:, :4], state[:, 4:12], state[:, 13:] = SIGMA, np.frombuffer(key, "<u4"), np.frombuffer(nonce, "<u4")
    state[:, 12] = (counter + np.arange(n)).astype(np.uint32)
    with np.errstate(over="ignore"):
        return (rounds(state) + state).astype("<u4").tobytes()[:size]


def subkey(key: bytes, nonce: bytes) -> bytes:
    state = np.concatenate([SIGMA, np.frombuffer(key, "<u4"), np.frombuffer(nonce, "<u4")])
    with np.errstate(over="ignore"):
        out = rounds(state)
    return np.concatenate([out[:4], out[12:]]).astype("<u4").tobytes()


def poly1305(key: bytes, data: bytes) -> bytes:
    r, s, p, a = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, int.from_bytes(key[16:], "little"), (1 << 130) - 5, 0
    for k in range(0, len(data), 16):
        a = (a + int.from_bytes(data[k : k + 16] + b"\1", "little")) * r % p
    return ((a + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def tag(key: bytes, nonce: bytes, cipher: bytes, extra: bytes) -> bytes:
    padded = lambda x: x + bytes(-len(x) % 16)
    return poly1305(stream(key, nonce, 32, 0), padded(extra) + padded(cipher) + len(extra).to_bytes(8, "little") + len(cipher).to_bytes(8, "little"))


def combined(data: bytes, pad: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(pad, np.uint8)).tobytes()


def seal(key: bytes, data: bytes, nonce: bytes | None = None, extra: bytes = b"") -> bytes:
    """The nonce of 24 bytes, the ciphertext, the tag of 16 bytes."""
    nonce = os.urandom(24) if nonce is None else nonce
    own, inner = subkey(key, nonce[:16]), bytes(4) + nonce[16:]
    cipher = combined(data, stream(own, inner, len(data), 1))
    return nonce + cipher + tag(own, inner, cipher, extra)


def unseal(key: bytes, data: bytes, extra: bytes = b"") -> bytes | None:
    """The message, or None if it was changed or the key is another."""
    if len(data) < 40:
        return None
    nonce, cipher = data[:24], data[24:-16]
    own, inner = subkey(key, nonce[:16]), bytes(4) + nonce[16:]
    if not hmac.compare_digest(tag(own, inner, cipher, extra), data[-16:]):
        return None
    return combined(cipher, stream(own, inner, len(cipher), 1))
