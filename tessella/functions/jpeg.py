"""A baseline JPEG encoder on arrays: colour images without subsampling, quantisation by a rule, codes fitted to the image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

SIDE = 8
#: Places of a block in the order of rising frequency, each second diagonal upwards.
ZIGZAG = np.array(sorted(((u, v) for u in range(SIDE) for v in range(SIDE)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])))
_COSINES = np.sqrt(np.where(np.arange(SIDE) == 0, 1, 2) / SIDE)[:, None] * np.cos((2 * np.arange(SIDE)[None, :] + 1) * np.arange(SIDE)[:, None] * np.pi / (2 * SIDE))
#: Rows for Y, Cb, Cr of the JFIF colour space (fixed values).
_COLOURS = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
LONGEST = 16


def quantisation(quality: int) -> np.ndarray:
    """Steps by place (rows of frequencies): finer for low frequencies and high quality (1 to 100)."""
    coarse = 6 * (100 - min(100, max(1, quality))) / 100
    return np.clip(np.rint(1 + coarse * (2 + np.add.outer(np.arange(SIDE), np.arange(SIDE)))), 1, 255).astype(int)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a prefix code of at most LONGEST bits in which no code has ones only."""
    # a symbol that never comes takes the code of ones only; counts are flattened until the longest code fits
    weights, extra = {**counts, -1: 0}, 0
    while True:
        heap = [(w + extra, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))]
        heapq.heapify(heap)
        lengths, number = dict.fromkeys(weights, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
            number += 1
        if max(lengths.values()) <= LONGEST:
            break
        extra = 2 * extra + 1 + sum(counts.values()) // 1000
    # the spare symbol goes to the end, where the code of ones only is
    longest = max(lengths.values())
    if lengths[-1] < longest:
        other = max(counts, key=lambda s: lengths[s])
        lengths[other], lengths[-1] = lengths[-1], lengths[other]
    del lengths[-1]
    return lengths


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(table as it stands in the file, (code, length) of each symbol)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, before = {}, 0, 0
    for s in order:
        code <<= lengths[s] - before
        codes[s], before = (code, lengths[s]), lengths[s]
        code += 1
    number = [sum(1 for s in order if lengths[s] == n) for n in range(1, LONGEST + 1)]
    return bytes(number) + bytes(order), codes


def _blocks(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Quantised coefficients (blocks x 64) in the order of rising frequency."""
    h, w = plane.shape
    parts = plane.reshape(h // SIDE, SIDE, w // SIDE, SIDE).transpose(0, 2, 1, 3).reshape(-1, SIDE, SIDE)
    made = np.rint(_COSINES @ parts @ _COSINES.T / steps).astype(int)
    return made[:, ZIGZAG[:, 0], ZIGZAG[:, 1]]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(int)


def _symbols(blocks: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each block (symbol, value bits, their number): first the difference of the mean, then runs of zeros with the value that ends them."""
    first = np.diff(blocks[:, 0], prepend=0)
    bits = lambda v, n: v if v > 0 else v + (1 << n) - 1
    out = []
    for d, n, row in zip(first.tolist(), _size(first).tolist(), blocks, strict=True):
        made, last = [(n, bits(d, n), n)], 0
        at = np.flatnonzero(row[1:]) + 1
        for i, v, size in zip(at.tolist(), row[at].tolist(), _size(row[at]).tolist(), strict=True):
            run = i - last - 1
            made += [(0xF0, 0, 0)] * (run // 16)
            made.append(((run % 16) << 4 | size, bits(v, size), size))
            last = i
        if last < SIDE * SIDE - 1:
            made.append((0, 0, 0))
        out.append(made)
    return out


def _packed(values: list[int], lengths: list[int]) -> bytes:
    """Bits of all values, filled up with ones; a byte of ones is followed by one of zeros."""
    n = np.array(lengths)
    wide = np.array(values, np.uint32) << (32 - n).astype(np.uint32)
    wide[n == 0] = 0
    bits = np.unpackbits(wide.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    stream = bits[np.arange(32)[None, :] < n[:, None]]
    data = np.packbits(np.concatenate((stream, np.ones(-len(stream) % 8, np.uint8))))
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(rgb: np.ndarray, quality: int = 90) -> bytes:
    """A JPEG file of an image (height x width x 3 bytes, 1 to 65,535 a side)."""
    h, w = rgb.shape[:2]
    padded = np.pad(rgb, ((0, -h % SIDE), (0, -w % SIDE), (0, 0)), mode="edge").astype(float)
    planes = np.einsum("hwc,kc->khw", padded, _COLOURS)
    planes[0] -= 128
    steps = quantisation(quality)
    components = [_symbols(_blocks(p, steps)) for p in planes]
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for blocks in components:
        for block in blocks:
            for i, (symbol, _, _) in enumerate(block):
                counts[i > 0][symbol] = counts[i > 0].get(symbol, 0) + 1
    tables, codes = zip(*(canonical(code_lengths(c or {0: 1})) for c in counts), strict=True)
    values, lengths = [], []
    for triple in zip(*components, strict=True):
        for block in triple:
            for i, (symbol, value, n) in enumerate(block):
                code, length = codes[i > 0][symbol]
                values += (code, value)
                lengths += (length, n)
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes((i, 0x11, 0)) for i in (1, 2, 3))
    return b"".join(
        [
            b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), _segment(0xDB, b"\0" + bytes(steps[ZIGZAG[:, 0], ZIGZAG[:, 1]].tolist())), _segment(0xC0, frame),
            _segment(0xC4, b"\x00" + tables[0]), _segment(0xC4, b"\x10" + tables[1]), _segment(0xDA, b"\x03" + b"\x01\0\x02\0\x03\0" + b"\0\x3f\0"), _packed(values, lengths), b"\xff\xd9",
        ]
    )
