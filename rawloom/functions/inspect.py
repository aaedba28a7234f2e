"""A tolerant look at a TIFF or BigTIFF file: byte order, size of its largest image, number of tags."""

from __future__ import annotations

import struct

#: Element sizes of the field types, BigTIFF's included.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
#: Directories with more entries are taken for damage; of more SubIFDs the first ones are looked at.
MOST_ENTRIES, MOST_SUB_DIRS = 4096, 16
WIDTH, LENGTH, SUB_DIRS = 256, 257, 330
_UNSIGNED = {1: "B", 2: "H", 4: "I", 8: "Q"}


class _Damaged(Exception):
    pass


def _directory(data: bytes, at: int, mark: str, big: bool) -> tuple[int, int | None, int | None, list[int]]:
    """Number of entries, width, height and SubIFD offsets."""

    def read(form: str, where: int) -> int:
        try:
            return struct.unpack_from(mark + form, data, where)[0]
        except struct.error as e:
            raise _Damaged from e

    n = read("Q" if big else "H", at)
    step, start, inline = (20, at + 8, 8) if big else (12, at + 2, 4)
    if n > MOST_ENTRIES or start + n * step > len(data):
        raise _Damaged
    size: dict[int, int] = {}
    below: list[int] = []
    for k in range(n):
        entry = start + k * step
        tag, kind = read("H", entry), read("H", entry + 2)
        if tag not in (WIDTH, LENGTH, SUB_DIRS) or kind not in SIZES:
            continue
        count, each = read("Q" if big else "I", entry + 4), SIZES[kind]
        where = entry + (12 if big else 8)
        if each * count > inline:
            where = read("Q" if big else "I", where)
        if tag == SUB_DIRS:
            for j in range(min(count, MOST_SUB_DIRS) if each in (4, 8) else 0):
                if where + (j + 1) * each > len(data):
                    break
                below.append(read(_UNSIGNED[each], where + j * each))
        elif where + each <= len(data):
            size[tag] = read(_UNSIGNED[each], where)
    return n, size.get(WIDTH), size.get(LENGTH), below


def look(data: bytes) -> dict | None:
    """byte_order, big_tiff, width, height, tag_count; None for what is no TIFF file or a damaged one.

    Width and height are those of the directory with the largest area among the first one and its SubIFDs; the
    first one wins ties."""
    mark = {b"II": "<", b"MM": ">"}.get(data[:2])
    if len(data) < 8 or mark is None:
        return None
    magic = struct.unpack_from(mark + "H", data, 2)[0]
    if magic not in (42, 43):
        return None
    big = magic == 43
    if big and (len(data) < 16 or struct.unpack_from(mark + "H", data, 4)[0] != 8):
        return None
    first = struct.unpack_from(mark + ("Q" if big else "I"), data, 8 if big else 4)[0]
    try:
        n, width, height, below = _directory(data, first, mark, big)
    except _Damaged:
        return None
    best = (width or 0) * (height or 0)
    for at in below:
        try:
            _, w, h, _ = _directory(data, at, mark, big)
        except _Damaged:
            continue
        if (w or 0) * (h or 0) > best:
            best, width, height = (w or 0) * (h or 0), w, h
    return {"byte_order": "little-endian" if mark == "<" else "big-endian", "big_tiff": big, "width": width, "height": height, "tag_count": n}
