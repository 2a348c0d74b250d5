"""Codecs for chunk payloads, and their registry."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Codec:
    """A pair of functions and the number that stands for it in archive headers."""

    code: int
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes], bytes]


#: "gzip" is the zlib container at its default level; bzip2 uses level 9.
CODECS: dict[str, Codec] = {
    "gzip": Codec(0, zlib.compress, zlib.decompress),
    "bzip2": Codec(1, lambda b: bz2.compress(b, 9), bz2.decompress),
    "none": Codec(2, lambda b: b, lambda b: b),
}


def codec(name: str) -> Codec:
    if name not in CODECS:
        raise KeyError(f"no codec named {name}; there are {sorted(CODECS)}")
    return CODECS[name]


def codec_by_code(code: int) -> Codec:
    for c in CODECS.values():
        if c.code == code:
            return c
    raise ValueError(f"no codec has the number {code}")


def register_codec(name: str, made: Codec) -> None:
    if name in CODECS or any(c.code == made.code for c in CODECS.values()):
        raise ValueError(f"a codec has the name {name} or the number {made.code}")
    CODECS[name] = made


def bounded(decompress: Callable[[bytes], bytes], limit: int | None) -> Callable[[bytes], bytes]:
    """decompress that refuses results above the limit (none: no limit)."""

    def run(data: bytes) -> bytes:
        out = decompress(data)
        if limit is not None and len(out) > limit:
            raise ValueError(f"a chunk has {len(out)} bytes; the limit is {limit}")
        return out

    return run
