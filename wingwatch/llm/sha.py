"""SHA-256 with open states, for many messages at once.

A state is eight 32-bit words; ``states`` arrays are (8, n) uint32.  ``feed`` takes one 64-byte block
per message.  The hex text of a digest is exactly one block, so the hash of several digests is one
``feed`` each and one closing block, and a state between two digests is a whole midstate.
"""

from __future__ import annotations

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_fraction(p: int, k: int) -> int:
    """First 32 bits of the fraction of the k-th root of p."""
    target, low, high = p << (32 * k), 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid ** k <= target else (low, mid)
    return low & 0xFFFFFFFF


ROUND = np.array([_root_fraction(p, 3) for p in _primes(64)], np.uint32)
START = np.array([_root_fraction(p, 2) for p in _primes(8)], np.uint32)
_ASCII = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_N = np.arange(65536)
#: four hex characters of 16 bits, as one big-endian word
_HEX = (_ASCII[_N >> 12] << 24) | (_ASCII[(_N >> 8) & 15] << 16) | (_ASCII[(_N >> 4) & 15] << 8) | _ASCII[_N & 15]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def feed(states: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States after one more block; ``block`` is (16, n), or (16, 1) where all messages get the same."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3)))
                 + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = states
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + ROUND[i])
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t, c, b, a, t + u
    return states + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def begin(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The hex text of (8, n) digests as (16, n) blocks."""
    out = np.empty((16, *digests.shape[1:]), np.uint32)
    out[0::2], out[1::2] = _HEX[digests >> np.uint32(16)], _HEX[digests & np.uint32(0xFFFF)]
    return out


def closing(blocks: np.ndarray) -> np.ndarray:
    """The last block of messages that had ``blocks`` (n,) whole blocks before it."""
    out = np.zeros((16, len(blocks)), np.uint32)
    out[0], out[15] = np.uint32(0x80000000), blocks.astype(np.uint32) * np.uint32(512)
    return out


def from_bytes(raw: bytes | np.ndarray) -> np.ndarray:
    """32-byte digests (or states), one after the other, as (8, n)."""
    return np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32)


def to_bytes(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()
