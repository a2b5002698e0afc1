"""Bit planes with lazy signs: from the highest plane, each coefficient's bit, and its sign behind its first 1."""

from __future__ import annotations

import numpy as np


def planes(v: np.ndarray) -> int:
    return int(np.abs(v).max(initial=0)).bit_length()


def encode(v: np.ndarray, n: int) -> list[bytes]:
    a, out = np.abs(v.astype(np.int64)), []
    for p in range(n - 1, -1, -1):
        bit, first = (a >> p) & 1, (a >> p) == 1
        pairs = np.stack((bit, (v < 0).astype(np.int64)), 1)
        keep = np.stack((np.ones(len(v), bool), first), 1)
        out.append(np.packbits(pairs[keep].astype(np.uint8)).tobytes())
    return out


def decode(layers: list[bytes | None], count: int, n: int) -> np.ndarray:
    """Coefficients from the layers before the first one that is missing."""
    a, sign = np.zeros(count, np.int64), np.ones(count, np.int64)
    for i, layer in enumerate(layers):
        if layer is None:
            break
        bits = np.unpackbits(np.frombuffer(layer, np.uint8))
        at, p = 0, n - 1 - i
        for j in range(count):
            bit = int(bits[at]) if at < len(bits) else 0
            at += 1
            if bit:
                if a[j] == 0:
                    sign[j] = -1 if at < len(bits) and bits[at] else 1
                    at += 1
                a[j] |= 1 << p
    return a * sign
