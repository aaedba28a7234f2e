"""Packed segment bytes and 16-bit samples."""

from __future__ import annotations

import numpy as np

from rawloom.functions.errors import FrameError

DEPTHS = (8, 10, 12, 14, 16)


def packed_bytes(count: int, depth: int) -> int:
    """Bytes that hold `count` samples."""
    return -(-count * depth // 8)


def unpack(data: bytes, depth: int, endian: str, count: int) -> np.ndarray:
    """The first `count` samples of a segment; what follows (padding) is ignored.

    8 and 16 bits are whole bytes, 16 in the file's byte order; 10, 12 and 14 bits are packed from the most
    significant bit on, whatever the byte order."""
    if depth not in DEPTHS:
        raise FrameError("UnsupportedBitDepth", f"samples of {depth} bits; depths are {DEPTHS}")
    need = packed_bytes(count, depth)
    if len(data) < need:
        raise FrameError("SegmentTooShort", f"{count} samples of {depth} bits take {need} bytes, not {len(data)}")
    if depth == 8:
        return np.frombuffer(data, np.uint8, count).astype(np.uint16)
    if depth == 16:
        return np.frombuffer(data, "<u2" if endian == "Little" else ">u2", count).astype(np.uint16)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, need), count=count * depth).reshape(count, depth)
    return bits @ (1 << np.arange(depth - 1, -1, -1, dtype=np.uint16))


def pack(samples: np.ndarray, depth: int, endian: str) -> bytes:
    """The inverse of unpack(); a last incomplete byte is filled up with zero bits."""
    if depth not in DEPTHS:
        raise FrameError("UnsupportedBitDepth", f"samples of {depth} bits; depths are {DEPTHS}")
    samples = np.asarray(samples, np.uint16)
    if depth < 16 and len(samples) and int(samples.max()) >> depth:
        raise FrameError("SampleOutOfRange", f"a sample of {int(samples.max())} among samples of {depth} bits")
    if depth == 8:
        return samples.astype(np.uint8).tobytes()
    if depth == 16:
        return samples.astype("<u2" if endian == "Little" else ">u2").tobytes()
    bits = (samples[:, None] >> np.arange(depth - 1, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()
