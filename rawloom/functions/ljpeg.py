"""Lossless JPEG (ITU-T T.81, process 14, predictor 1): whole streams to and from samples."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import numpy as np

from rawloom.functions.errors import FrameError

SOI, EOI, SOF3, DHT, SOS = 0xFFD8, 0xFFD9, 0xFFC3, 0xFFC4, 0xFFDA
#: Magnitude categories 0 to 16.
CATEGORIES = 17


def predictions(samples: np.ndarray, precision: int) -> np.ndarray:
    """Predictor 1 of samples (height, width, components): left, else above, else the middle of the range."""
    out = np.empty_like(samples)
    out[:, 1:] = samples[:, :-1]
    out[1:, 0] = samples[:-1, 0]
    out[0, 0] = 1 << (precision - 1)
    return out


def residuals(samples: np.ndarray, precision: int) -> np.ndarray:
    """Differences to the prediction modulo 2^16, as signed 16-bit numbers."""
    return (samples.astype(np.uint16) - predictions(samples, precision).astype(np.uint16)).view(np.int16)


def restore(differences: np.ndarray, precision: int) -> np.ndarray:
    """The inverse of residuals(): running sums down the first column, then along the rows, modulo 2^16."""
    d = differences.astype(np.int64)
    d[:, 0] = np.cumsum(d[:, 0], axis=0) + (1 << (precision - 1))
    return (np.cumsum(d, axis=1) & 0xFFFF).astype(np.uint16)


def categories(differences: np.ndarray) -> np.ndarray:
    """Bits of the absolute value: 0 for 0, 16 for -32768."""
    return np.frexp(np.abs(differences.astype(np.int64)).astype(np.float64))[1].astype(np.int64)


def code_lengths(histogram: list[int]) -> list[int]:
    """Code length of each category (0: unused) of an optimal code of 16 bits at most, by annex K.2 of the standard.

    A reserved symbol of frequency 1 keeps the all-ones code free.  Among equal frequencies the largest symbol
    merges first, which fixes the lengths."""
    groups = [(n, -k, [k]) for k, n in enumerate([*histogram, 1]) if n]
    heapq.heapify(groups)
    size = [0] * (len(histogram) + 1)
    while len(groups) > 1:
        n1, k1, a = heapq.heappop(groups)
        n2, _, b = heapq.heappop(groups)
        for k in a + b:
            size[k] += 1
        heapq.heappush(groups, (n1 + n2, k1, a + b))
    by_length = [0] * 64
    for s in size:
        by_length[s] += s > 0
    for length in range(63, 16, -1):
        while by_length[length]:
            shorter = max(j for j in range(1, length - 1) if by_length[j])
            by_length[length] -= 2
            by_length[length - 1] += 1
            by_length[shorter + 1] += 2
            by_length[shorter] -= 1
    by_length[max(j for j in range(1, 17) if by_length[j])] -= 1
    order = sorted((k for k in range(len(histogram)) if size[k]), key=lambda k: (size[k], k))
    lengths = [0] * len(histogram)
    spread = [length for length in range(1, 17) for _ in range(by_length[length])]
    for k, length in zip(order, spread, strict=True):
        lengths[k] = length
    return lengths


def canonical_codes(lengths: list[int]) -> list[int]:
    """Canonical codes: by length, then symbol, each the one before plus one, shifted to its length."""
    codes, code, last = [0] * len(lengths), 0, 0
    for length, k in sorted((n, k) for k, n in enumerate(lengths) if n):
        code <<= length - last
        codes[k], last = code, length
        code += 1
    return codes


def check(width: int, height: int, components: int, precision: int, samples: np.ndarray) -> None:
    """Raise for what a stream can't hold."""
    if not 1 <= components <= 4:
        raise FrameError("InvalidComponents", f"{components} components; a stream takes one to four")
    if not 2 <= precision <= 16:
        raise FrameError("InvalidPrecision", f"a precision of {precision} bits, not 2 to 16")
    if width < 1 or height < 1 or width > 65535 or height > 65535:
        raise FrameError("InvalidDimensions", f"an image of {width} by {height} samples")
    if samples.size != width * height * components:
        raise FrameError("SampleCountMismatch", f"{samples.size} samples for an image that takes {width * height * components}")
    if precision < 16 and int(samples.max()) >> precision:
        raise FrameError("SampleOutOfRange", f"a sample of {int(samples.max())} among samples of {precision} bits")


def _bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits of numbers of the given sizes, one after the other, padded to whole bytes with ones."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    place = np.arange(total) - np.repeat(ends - sizes, sizes)
    shift = np.repeat(sizes, sizes) - 1 - place
    bits = (np.repeat(values, sizes) >> shift) & 1
    return np.packbits(np.concatenate((bits, np.ones(-total % 8, bits.dtype))).astype(np.uint8))


def encode(samples: np.ndarray, width: int, height: int, components: int, precision: int) -> bytes:
    """A complete stream of interleaved samples; all components share one table."""
    samples = np.asarray(samples, np.uint16).ravel()
    check(width, height, components, precision, samples)
    d = residuals(samples.reshape(height, width, components), precision).ravel().astype(np.int64)
    cat = categories(d)
    histogram = np.bincount(cat, minlength=CATEGORIES)
    lengths = code_lengths(histogram.tolist())
    codes = canonical_codes(lengths)
    order = sorted((k for k in range(CATEGORIES) if lengths[k]), key=lambda k: (lengths[k], k))
    size, code = np.array(lengths)[cat], np.array(codes)[cat]
    extra = np.where(cat == 16, 0, cat)
    value = np.where(d >= 0, d, d + (1 << cat) - 1)
    entropy = _bits((code << extra) | np.where(extra > 0, value, 0), size + extra)
    stuffed = np.insert(entropy, np.flatnonzero(entropy == 0xFF) + 1, 0).astype(np.uint8)
    counts = [lengths.count(n) for n in range(1, 17)]
    frame = struct.pack(">BHHB", precision, height, width, components) + b"".join(bytes((c + 1, 0x11, 0)) for c in range(components))
    table = bytes((0, *counts, *order))
    scan = bytes((components,)) + b"".join(bytes((c + 1, 0)) for c in range(components)) + bytes((1, 0, 0))
    parts = [struct.pack(">HHH", SOI, SOF3, 2 + len(frame)), frame, struct.pack(">HH", DHT, 2 + len(table)), table, struct.pack(">HH", SOS, 2 + len(scan)), scan, stuffed.tobytes(), struct.pack(">H", EOI)]
    return b"".join(parts)


def encoded_bits(histogram: list[int]) -> int:
    """Bits of the entropy-coded data, before stuffing, from the histogram alone."""
    return sum(n * (length + (k if k < 16 else 0)) for k, (n, length) in enumerate(zip(histogram, code_lengths(histogram), strict=True)))


@dataclass
class Decoded:
    samples: np.ndarray
    width: int
    height: int
    components: int
    precision: int
    consumed: int


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FrameError("UnexpectedEof", "the stream ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return int.from_bytes(self.take(2))


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16-bit prefix its symbol and code length (symbol << 5 | length); 0 where no code begins so."""
    if sum(counts) != len(symbols):
        raise FrameError("Malformed", "a code table lists more or fewer symbols than it counts")
    out, code, k = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if code >= 1 << length:
                raise FrameError("Malformed", "a code table has more codes than their lengths allow")
            a = code << (16 - length)
            out[a : a + (1 << (16 - length))] = [symbols[k] << 5 | length] * (1 << (16 - length))
            code += 1
            k += 1
        code <<= 1
    return out


def decode(data: bytes) -> Decoded:
    """Samples of a stream and the bytes up to and with its end marker; what follows is left alone.

    Only SOF3, DHT and SOS segments may come before the scan."""
    cur = _Cursor(data)
    if (found := cur.u16()) != SOI:
        raise FrameError("InvalidMarker", f"{found:#06x} where the stream should begin with {SOI:#06x}")
    frame, tables = None, {}
    while True:
        marker = cur.u16()
        if marker == SOF3:
            frame = _frame_header(cur)
        elif marker == DHT:
            left = cur.u16() - 2
            if left < 0:
                raise FrameError("Malformed", "the code tables do not fill the length of their segment")
            while left > 0:
                head, counts = cur.u8(), cur.take(16)
                symbols = cur.take(sum(counts))
                left -= 17 + len(symbols)
                if head >> 4 or head & 15 > 3:
                    raise FrameError("Malformed", "a code table of a class or slot that lossless streams lack")
                tables[head & 15] = _lookup(counts, symbols)
            if left:
                raise FrameError("Malformed", "the code tables do not fill the length of their segment")
        elif marker == SOS:
            break
        else:
            raise FrameError("UnsupportedMarker", f"a segment {marker:#06x} before the scan")
    if frame is None:
        raise FrameError("Malformed", "the scan comes before any frame header")
    precision, height, width, ids = frame
    chosen = _scan_header(cur, ids, tables)
    differences, end = _entropy(data, cur.at, width * height * len(ids), chosen)
    cur.at = end
    if (found := cur.u16()) != EOI:
        raise FrameError("InvalidMarker", f"{found:#06x} after the scan, where {EOI:#06x} ends a stream")
    samples = restore(differences.reshape(height, width, len(ids)), precision).ravel()
    return Decoded(samples, width, height, len(ids), precision, cur.at)


def _frame_header(cur: _Cursor) -> tuple[int, int, int, list[int]]:
    length, precision, height, width, n = cur.u16(), cur.u8(), cur.u16(), cur.u16(), cur.u8()
    if not 2 <= precision <= 16:
        raise FrameError("InvalidPrecision", f"a precision of {precision} bits, not 2 to 16")
    if not 1 <= n <= 4:
        raise FrameError("InvalidComponents", f"the frame header names {n} components, not one to four")
    if width < 1 or height < 1:
        raise FrameError("InvalidDimensions", f"an image of {width} by {height} samples")
    if length != 8 + 3 * n:
        raise FrameError("Malformed", "the length of the frame header does not fit its components")
    ids = []
    for _ in range(n):
        ids.append(cur.u8())
        if cur.u8() != 0x11:
            raise FrameError("Unsupported", "a subsampled component")
        cur.u8()
    return precision, height, width, ids


def _scan_header(cur: _Cursor, ids: list[int], tables: dict[int, list[int]]) -> list[list[int]]:
    length, n = cur.u16(), cur.u8()
    if n != len(ids) or length != 6 + 2 * n:
        raise FrameError("Malformed", "the scan header does not name the components of the frame")
    chosen = []
    for _ in range(n):
        cur.u8()
        slot = cur.u8() >> 4
        if slot not in tables:
            raise FrameError("Malformed", "the scan names a code table that was not given")
        chosen.append(tables[slot])
    predictor = cur.u8()
    cur.take(2)
    if predictor != 1:
        raise FrameError("Unsupported", "a predictor other than the left neighbour")
    return chosen


def _entropy(data: bytes, start: int, count: int, tables: list[list[int]]) -> tuple[np.ndarray, int]:
    """`count` differences of the entropy-coded data, and where the marker after them is."""
    if count > 8 * (len(data) - start) + 64:
        raise FrameError("UnexpectedEof", "the stream ends too early")
    at, n, out = start, len(data), [0] * count
    acc = have = 0
    components = len(tables)
    for i in range(count):
        while have < 32:
            if at < n and (data[at] != 0xFF or (at + 1 < n and data[at + 1] == 0)):
                acc = acc << 8 | data[at]
                at += 2 if data[at] == 0xFF else 1
                have += 8
            else:
                break
        if have >= 16:
            prefix = acc >> (have - 16) & 0xFFFF
        else:
            prefix = acc << (16 - have) & 0xFFFF
        found = tables[i % components][prefix]
        length, cat = found & 31, found >> 5
        if not length or length > have:
            if have < 16:
                raise FrameError("UnexpectedEof", "the stream ends too early")
            raise FrameError("Malformed", "bits that no code of the table begins with")
        have -= length
        if cat == 0:
            continue
        if cat >= 16:
            if cat > 16:
                raise FrameError("Malformed", "a difference of more than 16 bits")
            out[i] = -32768
            continue
        if cat > have:
            raise FrameError("UnexpectedEof", "the stream ends too early")
        have -= cat
        value = acc >> have & ((1 << cat) - 1)
        out[i] = value if value >> (cat - 1) else value - (1 << cat) + 1
        acc &= (1 << have) - 1
    # Whole bytes that were read ahead go back, with their stuffing.
    for _ in range(have // 8):
        at -= 2 if at - 2 >= start and data[at - 1] == 0 and data[at - 2] == 0xFF else 1
    return np.array(out, np.int64), at
