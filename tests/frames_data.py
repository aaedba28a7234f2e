"""Frames that the tests are about, all made by the library's own writer."""

from __future__ import annotations

import numpy as np

from rawloom.functions import samples, tiff


def entries(endian, *triples):
    return sorted((tiff.make(t, k, v, endian) for t, k, v in triples), key=lambda e: e.tag)


def raw_directory(levels, width, height, depth=16, components=1, endian="Little", tail=b"", rows=None, extra=()):
    """An uncompressed image in strips of `rows` rows."""
    rows = rows or height
    levels = np.asarray(levels, np.uint16).reshape(height, width * components)
    segments = [samples.pack(levels[k : k + rows].ravel(), depth, endian) + tail for k in range(0, height, rows)]
    tags = entries(endian, (256, 4, [width]), (257, 4, [height]), (258, 3, [depth] * components), (259, 3, [1]), (277, 3, [components]), (0x9000, 2, b"frame-meta\0"), *extra)
    return tiff.Directory(entries=tags, layout="Strips", rows_per_strip=rows, segments=segments)


def gradient(endian="Little", side=8):
    y, x = np.mgrid[:side, :side]
    return tiff.Frame(endian, [raw_directory(x * 5 + y * 2, side, side, endian=endian)])


def tiled(endian="Little"):
    d = raw_directory(np.zeros(16), 4, 4, endian=endian)
    d.layout, d.rows_per_strip, d.tile_width, d.tile_length = "Tiles", None, 2, 2
    d.segments = [samples.pack(np.arange(100 * t, 100 * t + 4), 16, endian) for t in range(4)]
    return tiff.Frame(endian, [d])


def note(endian):
    """A maker note of one entry outside its directory, at 30 in the note, as it is in a file at offset 1000."""
    mark = tiff.order(endian)
    import struct

    body = struct.pack(mark + "HHHII", 1, 0x10, 2, 6, 1030) + struct.pack(mark + "I", 0)
    return (b"SIGMA\0\0\0\x01\x02" + body).ljust(30, b"\0") + b"hello\0"


def rich(endian="Little"):
    """Two top directories, a tiled one below the first, Exif with a maker note and interoperability, GPS."""
    top = tiff.Directory(entries=entries(endian, (254, 4, [1]), (256, 3, [4]), (257, 3, [2]), (259, 3, [7]), (271, 2, b"Maker\0"), (50714, 5, [[1, 2], [3, 0]])), layout="Strips", rows_per_strip=2, segments=[b"\xff\xd8jpeg\xff\xd9"])
    raw = tiled(endian).directories[0]
    raw.parent, raw.edge = 0, "sub"
    exif = tiff.Directory(0, "pointer", 0, 34665, entries(endian, (33434, 5, [[1, 50]]), (37500, 7, note(endian)), (37380, 10, [[-1, 3]])), note_origin=1000)
    interop = tiff.Directory(2, "pointer", 2, 40965, entries(endian, (1, 2, b"R98\0")))
    gps = tiff.Directory(0, "pointer", 1, 34853, entries(endian, (0, 1, bytes([2, 3, 0, 0])), (4, 12, [1.5, -2.5]), (5, 11, [0.25]), (6, 6, [-3, 4]), (7, 8, [-300]), (8, 9, [-70000])))
    second = tiff.Directory(ordinal=1, entries=entries(endian, (270, 2, b"second page\0")))
    return tiff.Frame(endian, [top, raw, exif, interop, gps, second])
