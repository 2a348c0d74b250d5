"""Content-defined chunking by a Rabin fingerprint, vectorised.

The rolling value after byte i of a chunk that starts at c is, over GF(2) modulo a polynomial P of degree 32,
``h[i] = S[i] + x^8 S[i - w]`` with S the fingerprint of the chunk's bytes so far and w the window (the outgoing byte is
not shifted, so a value depends on all bytes since the chunk's start). A chunk ends at the first i with i - c + 1 >= w
and the low bits of h zero.

S of a chunk follows from the fingerprint G of the whole buffer: S[i] = G[i] + x^(8(i-c+1)) G[c-1]. So G is made once
for a batch of buffers, in columns, and each search for a cut adds to low bits of G[i] + x^8 G[i-w] one fixed row for
each bit of G[c-1]; there is no loop over bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Low 32 bits of the degree-32 polynomial; cut mask; least window (fixed values).
POLYNOMIAL, MASK, WINDOW = 0x45C2B6A1, 0xFFF, 32
_ROWS = 512


def reduction_table(polynomial: int = POLYNOMIAL) -> np.ndarray:
    """For each byte b: b * x^32 modulo the polynomial."""
    value = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        high = value >> np.uint64(31) & np.uint64(1)
        value = (value << np.uint64(1) & np.uint64(0xFFFFFFFF)) ^ high * np.uint64(polynomial)
    return value.astype(np.uint32)


_TABLE = reduction_table()


def times_x8(v: np.ndarray) -> np.ndarray:
    return (v << np.uint32(8)) ^ _TABLE[v >> np.uint32(24)]


def buffer_fingerprints(data: np.ndarray) -> np.ndarray:
    """G: the fingerprint after each byte of the buffer."""
    n = len(data)
    rows = max(1, -(-n // _ROWS))
    padded = np.zeros(rows * _ROWS, np.uint32)
    padded[:n] = data
    columns = np.ascontiguousarray(padded.reshape(rows, _ROWS).T)
    local = np.empty_like(columns)
    state = np.zeros(rows, np.uint32)
    for t in range(_ROWS):
        state = times_x8(state) ^ columns[t]
        local[t] = state
    # value before each row, carried from row to row by x^(8 * rows' length)
    step = _power_tables(8 * _ROWS)
    carry, before = 0, np.zeros(rows, np.uint32)
    for r, last in enumerate(state.tolist()):
        before[r] = carry
        carry = step[0][carry & 255] ^ step[1][carry >> 8 & 255] ^ step[2][carry >> 16 & 255] ^ step[3][carry >> 24] ^ last
    for t in range(_ROWS):
        before = times_x8(before)
        local[t] ^= before
    return local.T.reshape(-1)[:n]


@lru_cache(maxsize=8)
def _power_tables(exponent: int) -> list[list[int]]:
    """Tables of (byte << 8k) * x^exponent for k = 0..3."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(exponent // 8):
        basis = times_x8(basis)
    tables = []
    for k in range(4):
        table = np.zeros(256, np.uint32)
        for bit in range(8):
            table[np.arange(256) >> bit & 1 == 1] ^= basis[8 * k + bit]
        tables.append(table.tolist())
    return tables


@lru_cache(maxsize=2)
def _powers(length: int) -> np.ndarray:
    """x^(8j) * x^bit for j = 0..length, rows (j, bit)."""
    power = np.zeros((length + 1, 32), np.uint32)
    power[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for j in range(1, length + 1):
        power[j] = times_x8(power[j - 1])
    return power


@lru_cache(maxsize=4)
def _corrections(window: int, mask: int, length: int) -> np.ndarray:
    """Rows (bit, j): low bits of (x^(8(j+1)) + [j >= w] x^(8(j-w+2))) * x^bit for the position j of a chunk."""
    power = _powers(length)
    out = power[1:].copy()
    if length > window:
        out[window:] ^= power[2 : length - window + 2]
    return np.ascontiguousarray((out & np.uint32(mask)).T).astype(np.uint16 if mask <= 0xFFFF else np.uint32)


def _bits(seed: int) -> list[int]:
    return [b for b in range(32) if seed >> b & 1]


class Cutter:
    """Finds the cuts of a byte array; its fingerprints are made once."""

    #: Positions of a chunk that the table of corrections has; beyond them the seed is carried on and the table used again.
    LENGTH, BLOCK = 16_384, 2048

    def __init__(self, data: np.ndarray, window: int = WINDOW, mask: int = MASK) -> None:
        self.w, self.mask, self.g = window, mask, buffer_fingerprints(data)
        low = self.g.copy()
        if len(low) > window:
            low[window:] ^= times_x8(self.g[:-window])
        self.low = (low & np.uint32(mask)).astype(np.uint16 if mask <= 0xFFFF else np.uint32)
        self.length = max(self.LENGTH, 4 * window)
        self.table = _corrections(window, mask, self.length)

    def next(self, c: int, end: int) -> int:
        """Where the chunk that begins at c ends, at most at ``end``; a rest below the window is a chunk of its own."""
        w = self.w
        if end - c < w:
            return end
        seed = int(self.g[c - 1]) if c else 0
        bits = _bits(seed)
        # the last byte of the first window: no outgoing byte yet, and what lies before the chunk must not come in
        first = int(self.g[c + w - 1]) & self.mask
        for b in bits:
            first ^= int(self.table[b, w - 1])
        if first & self.mask == 0:
            return c + w
        j, block, shift = w, self.BLOCK, 0
        while c + j < end:
            hi = min(j + block, end - c)
            if hi - shift > self.length:
                # corrections of seed * x^(8 ahead) at j - ahead are those of seed at j
                ahead = j - shift - w
                seed = int(np.bitwise_xor.reduce(_powers(self.length)[ahead][bits])) if bits else 0
                bits, shift = _bits(seed), shift + ahead
                hi = min(hi, j + self.length - w)
            value = self.low[c + j : c + hi].copy()
            for b in bits:
                value ^= self.table[b, j - shift : hi - shift]
            hit = np.flatnonzero(value == 0)
            if len(hit):
                return c + j + int(hit[0]) + 1
            j, block = hi, min(block * 2, self.length // 2)
        return end

    def lengths(self, start: int, end: int) -> list[int]:
        """Lengths of the chunks of a range that is a buffer of its own."""
        out = []
        while start < end:
            stop = self.next(start, end)
            out.append(stop - start)
            start = stop
        return out


def cuts(buffers: list[bytes], window: int = WINDOW, mask: int = MASK) -> list[list[int]]:
    """Chunk lengths of each buffer, by position from its start; a rest below the window is a chunk of its own."""
    data = np.frombuffer(b"".join(buffers), np.uint8)
    if not len(data):
        return [[] for _ in buffers]
    cutter, at, out = Cutter(data, window, mask), 0, []
    for b in buffers:
        out.append(cutter.lengths(at, at + len(b)))
        at += len(b)
    return out
