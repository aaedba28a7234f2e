"""Classic TIFF/DNG trees: bytes to a flat list of directories and back."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from rawloom.functions.errors import FrameError

#: Field types: code to (element size, numpy kind); rationals are pairs of 32-bit numbers.
TYPES = {1: (1, "u1"), 2: (1, "u1"), 3: (2, "u2"), 4: (4, "u4"), 5: (8, "u4"), 6: (1, "i1"), 7: (1, "u1"), 8: (2, "i2"), 9: (4, "i4"), 10: (8, "i4"), 11: (4, "f4"), 12: (8, "f8")}
SHORT, LONG = 3, 4
WIDTH, LENGTH, BITS, COMPRESSION, SAMPLES_PER_PIXEL, PLANAR = 256, 257, 258, 259, 277, 284
STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS = 273, 278, 279
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SUB_DIRS = 322, 323, 324, 325, 330
#: Exif, GPS and interoperability directories, in the order in which they are read.
POINTERS = (34665, 34853, 40965)
#: Tags that describe where things are; they become fields of a directory and are made anew when written.
STRUCTURAL = frozenset((STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SUB_DIRS))
MAKER_NOTE, MAKER_NOTE_SAFETY = 37500, 50741
#: Maker notes whose inner offsets count from the start of the file, and where their directory begins.
ABSOLUTE_NOTES, NOTE_DIRECTORY = (b"SIGMA\0\0\0", b"FOVEON\0\0"), 10
#: Directories nest no deeper than this, and a file has no more of them; a cyclic file would never end otherwise.
DEEPEST, MOST = 32, 100_000


@dataclass(frozen=True)
class Entry:
    """A tag with its elements as they are in the file, in the file's byte order."""

    tag: int
    kind: int
    count: int
    raw: bytes


@dataclass
class Directory:
    """A directory; parent is its place in the list (-1: top level), edge one of top, sub, pointer."""

    parent: int = -1
    edge: str = "top"
    ordinal: int = 0
    pointer: int | None = None
    entries: list[Entry] = field(default_factory=list)
    layout: str | None = None
    rows_per_strip: int | None = None
    tile_width: int | None = None
    tile_length: int | None = None
    segments: list[bytes] | None = None
    note_origin: int | None = None

    def get(self, tag: int) -> Entry | None:
        return next((e for e in self.entries if e.tag == tag), None)

    def put(self, entry: Entry) -> None:
        """Insert or replace an entry, keeping the order of tags."""
        self.entries = sorted([*(e for e in self.entries if e.tag != entry.tag), entry], key=lambda e: e.tag)

    def remove(self, tag: int) -> None:
        self.entries = [e for e in self.entries if e.tag != tag]


@dataclass
class Frame:
    """endian: Little or Big; directories in the order in which they are written: a directory, what is below it by
    SubIFDs, what is below it by pointers."""

    endian: str
    directories: list[Directory]

    def copy(self) -> Frame:
        return Frame(self.endian, [replace(d, entries=list(d.entries), segments=None if d.segments is None else list(d.segments)) for d in self.directories])


def order(endian: str) -> str:
    return "<" if endian == "Little" else ">"


def values(entry: Entry | None, endian: str) -> np.ndarray | None:
    """The elements of an entry; rationals as rows of numerator and denominator."""
    if entry is None:
        return None
    found = np.frombuffer(entry.raw, order(endian) + TYPES[entry.kind][1])
    return found.reshape(-1, 2) if entry.kind in (5, 10) else found


def integers(entry: Entry | None, endian: str) -> list[int] | None:
    """The elements of a byte, short or long entry; None for other types and for no entry."""
    return values(entry, endian).tolist() if entry is not None and entry.kind in (1, SHORT, LONG) else None


def first(directory: Directory, tag: int, endian: str, default: int | None = None) -> int | None:
    found = integers(directory.get(tag), endian)
    return found[0] if found else default


def numbers(entry: Entry | None, endian: str) -> list[float]:
    """The elements of any numeric entry in single precision; a rational over 0 is 0, text has none."""
    if entry is None or entry.kind == 2:
        return []
    found = values(entry, endian).astype(np.float32)
    if entry.kind in (5, 10):
        top, bottom = found[:, 0], found[:, 1]
        found = np.divide(top, bottom, out=np.zeros_like(top), where=bottom != 0)
    return [float(x) for x in found]


def canonical(entry: Entry, endian: str) -> bytes:
    """Type code and elements in little-endian order: equal for equal values of files of either order."""
    return struct.pack("<H", entry.kind) + np.frombuffer(entry.raw, order(endian) + TYPES[entry.kind][1]).astype("<" + TYPES[entry.kind][1]).tobytes()


def make(tag: int, kind: int, elements, endian: str) -> Entry:
    """An entry from elements: bytes for types 1, 2 and 7, numbers or (flattened) pairs of numbers otherwise."""
    if isinstance(elements, bytes):
        return Entry(tag, kind, len(elements) // TYPES[kind][0], elements)
    made = np.array(elements).ravel().astype(order(endian) + TYPES[kind][1])
    return Entry(tag, kind, len(made) // (2 if kind in (5, 10) else 1), made.tobytes())


class _Parser:
    def __init__(self, data: bytes, endian: str) -> None:
        self.data, self.endian, self.out = data, endian, []
        self.u16_format, self.u32_format = order(endian) + "H", order(endian) + "I"

    def slice(self, at: int, n: int) -> bytes:
        if at + n > len(self.data):
            raise FrameError("Truncated", f"the file ends before byte {at + n}")
        return self.data[at : at + n]

    def u16(self, at: int) -> int:
        return struct.unpack(self.u16_format, self.slice(at, 2))[0]

    def u32(self, at: int) -> int:
        return struct.unpack(self.u32_format, self.slice(at, 4))[0]

    def field(self, at: int) -> tuple[Entry, int | None]:
        """An entry, and where its elements are if that is outside the directory."""
        tag, kind, count = self.u16(at), self.u16(at + 2), self.u32(at + 4)
        if kind not in TYPES:
            raise FrameError("UnknownFieldType", f"a field of type {kind}")
        size = TYPES[kind][0] * count
        where = at + 8 if size <= 4 else self.u32(at + 8)
        return Entry(tag, kind, count, self.slice(where, size)), None if size <= 4 else where

    def directory(self, at: int, parent: int, edge: str, ordinal: int, pointer: int | None, safe: bool, depth: int) -> int:
        """Read a directory and all below it; returns where the next one of its chain is."""
        if depth > DEEPEST or len(self.out) >= MOST:
            raise FrameError("TooDeep", "directories nest too deep or are too many")
        n = self.u16(at)
        fields = [self.field(at + 2 + 12 * k) for k in range(n)]
        following = self.u32(at + 2 + 12 * n)
        by_tag: dict[int, Entry] = {}
        for entry, _ in fields:
            by_tag.setdefault(entry.tag, entry)
        made = Directory(parent, edge, ordinal, pointer)
        own = len(self.out)
        self.out.append(made)
        told = integers(by_tag.get(MAKER_NOTE_SAFETY), self.endian)
        below = told[0] == 1 if told else safe
        for k, offset in enumerate(integers(by_tag.get(SUB_DIRS), self.endian) or ()):
            self.directory(offset, own, "sub", k, None, below, depth + 1)
        for k, tag in enumerate(POINTERS):
            if offsets := integers(by_tag.get(tag), self.endian):
                self.directory(offsets[0], own, "pointer", k, tag, below, depth + 1)
        self.image(made, by_tag)
        if not safe:
            made.note_origin = next((where for entry, where in reversed(fields) if entry.tag == MAKER_NOTE and where is not None), None)
        made.entries = sorted((e for e, _ in fields if e.tag not in STRUCTURAL and e.tag not in POINTERS), key=lambda e: e.tag)
        return following

    def image(self, made: Directory, by_tag: dict[int, Entry]) -> None:
        """Tiles if both their tags are there, else strips, else no image."""
        get = lambda tag: integers(by_tag.get(tag), self.endian)
        for layout, at, sizes in (("Tiles", get(TILE_OFFSETS), get(TILE_COUNTS)), ("Strips", get(STRIP_OFFSETS), get(STRIP_COUNTS))):
            if at is None or sizes is None:
                continue
            made.layout = layout
            if layout == "Tiles":
                for tag, name in ((TILE_WIDTH, "tile_width"), (TILE_LENGTH, "tile_length")):
                    if not (found := get(tag)):
                        raise FrameError("Inconsistent", f"inconsistent DNG: {name.replace('_', ' ')}")
                    setattr(made, name, found[0])
            else:
                made.rows_per_strip = next((x[0] for x in (get(ROWS_PER_STRIP), get(LENGTH)) if x), 0)
            if len(at) != len(sizes):
                raise FrameError("Inconsistent", "an image with more or fewer offsets than sizes of its segments")
            made.segments = [self.slice(a, n) for a, n in zip(at, sizes, strict=True)]
            return


def parse(data: bytes) -> Frame:
    """The tree of a file.  A chain of top directories that comes back on itself ends there."""
    endian = {b"II": "Little", b"MM": "Big"}.get(data[:2])
    if len(data) < 2:
        raise FrameError("Truncated", "the file has no room for a byte order")
    if endian is None:
        raise FrameError("BadByteOrder", "the file begins with no byte order")
    parser = _Parser(data, endian)
    if (magic := parser.u16(2)) != 42:
        raise FrameError("BadMagic", f"{magic} after the byte order, where 42 stands in a TIFF file")
    at, seen, k = parser.u32(4), set(), 0
    while at and at not in seen:
        seen.add(at)
        at = parser.directory(at, -1, "top", k, None, False, 0)
        k += 1
    return Frame(endian, parser.out)


def shift_note(raw: bytes, endian: str, old: int, new: int) -> bytes:
    """A maker note whose file-absolute offsets follow it from old to new.

    Only flat directories of a known signature whose offsets all lie within the note are changed; any other note
    is returned as it is."""
    if old == new or not raw.startswith(ABSOLUTE_NOTES):
        return raw
    u16, u32 = order(endian) + "H", order(endian) + "I"
    out = bytearray(raw)
    try:
        n = struct.unpack_from(u16, raw, NOTE_DIRECTORY)[0]
        if struct.unpack_from(u32, raw, NOTE_DIRECTORY + 2 + 12 * n)[0]:
            return raw
        for k in range(n):
            at = NOTE_DIRECTORY + 2 + 12 * k
            kind, count = struct.unpack_from(u16, raw, at + 2)[0], struct.unpack_from(u32, raw, at + 4)[0]
            if kind not in TYPES:
                return raw
            if TYPES[kind][0] * count <= 4:
                continue
            offset = struct.unpack_from(u32, raw, at + 8)[0]
            if not old <= offset < old + len(raw):
                return raw
            struct.pack_into(u32, out, at + 8, offset + new - old)
    except struct.error:
        return raw
    return bytes(out)


def _even(n: int) -> int:
    return n + n % 2


def serialise(frame: Frame) -> bytes:
    """The file of a tree: each directory, its long elements and its segments, one after the other, on even offsets."""
    mark, endian, nodes = order(frame.endian), frame.endian, frame.directories
    longs = lambda tag, elements: make(tag, LONG, list(elements), endian)
    plans, cursor = [], 8
    children: list[dict[str, list[int]]] = [{"sub": [], "pointer": []} for _ in nodes]
    for k, node in enumerate(nodes):
        if node.edge != "top":
            children[node.parent][node.edge].append(k)
    for k, node in enumerate(nodes):
        entries = list(node.entries)
        segments = node.segments or []
        sizes = [len(x) for x in segments]
        if node.layout == "Strips":
            entries += [longs(STRIP_OFFSETS, [0] * len(segments)), longs(ROWS_PER_STRIP, [node.rows_per_strip]), longs(STRIP_COUNTS, sizes)]
        elif node.layout == "Tiles":
            entries += [longs(TILE_WIDTH, [node.tile_width]), longs(TILE_LENGTH, [node.tile_length]), longs(TILE_OFFSETS, [0] * len(segments)), longs(TILE_COUNTS, sizes)]
        if children[k]["sub"]:
            entries.append(longs(SUB_DIRS, [0] * len(children[k]["sub"])))
        entries += [longs(nodes[c].pointer, [0]) for c in children[k]["pointer"]]
        entries.sort(key=lambda e: e.tag)
        if len(entries) > 65535:
            raise FrameError("ValueTooLarge", "a file beyond what 32-bit offsets reach")
        at, cursor = cursor, cursor + 6 + 12 * len(entries)
        places = []
        for entry in entries:
            if len(entry.raw) > 4:
                cursor = _even(cursor)
                places.append(cursor)
                cursor += len(entry.raw)
            else:
                places.append(0)
        spots = []
        for size in sizes:
            cursor = _even(cursor)
            spots.append(cursor)
            cursor += size
        plans.append((at, entries, places, spots))
    if cursor >= 1 << 32:
        raise FrameError("ValueTooLarge", "a file beyond what 32-bit offsets reach")
    out = bytearray(cursor)
    tops = [k for k, node in enumerate(nodes) if node.edge == "top"]
    following = {a: plans[b][0] for a, b in zip(tops, tops[1:], strict=False)}
    struct.pack_into(mark + "2sHI", out, 0, b"II" if endian == "Little" else b"MM", 42, plans[tops[0]][0] if tops else 0)
    for k, (at, entries, places, spots) in enumerate(plans):
        node = nodes[k]
        made = {STRIP_OFFSETS: spots, TILE_OFFSETS: spots, SUB_DIRS: [plans[c][0] for c in children[k]["sub"]]}
        made |= {nodes[c].pointer: [plans[c][0]] for c in children[k]["pointer"]}
        struct.pack_into(mark + "H", out, at, len(entries))
        for j, (entry, place) in enumerate(zip(entries, places, strict=True)):
            raw = entry.raw
            if entry.tag in made and (entry.tag in STRUCTURAL or entry.tag in POINTERS):
                raw = longs(entry.tag, made[entry.tag]).raw
            elif entry.tag == MAKER_NOTE and place and node.note_origin is not None:
                raw = shift_note(raw, endian, node.note_origin, place)
            struct.pack_into(mark + "HHI", out, at + 2 + 12 * j, entry.tag, entry.kind, entry.count)
            if place:
                struct.pack_into(mark + "I", out, at + 10 + 12 * j, place)
                out[place : place + len(raw)] = raw
            else:
                out[at + 10 + 12 * j : at + 10 + 12 * j + len(raw)] = raw
        struct.pack_into(mark + "I", out, at + 2 + 12 * len(entries), following.get(k, 0))
        for spot, segment in zip(spots, node.segments or [], strict=True):
            out[spot : spot + len(segment)] = segment
    return bytes(out)
