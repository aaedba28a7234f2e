"""Lossless compression of the images of a frame, its inverse, and proof that the one undoes the other."""

from __future__ import annotations

from dataclasses import dataclass

from rawloom.functions import ljpeg, samples, tiff
from rawloom.functions.errors import FrameError
from rawloom.functions.tiff import Directory, Entry, Frame

UNCOMPRESSED, LOSSLESS_JPEG = 1, 7
#: The private tag of compressed directories and its value, which files that were compressed elsewhere in
#: this format carry.
MARKER_TAG, MARKER_VALUE = 0xA1E9, 0x414C5048


@dataclass(frozen=True)
class Geometry:
    precision: int
    components: int
    width: int
    height: int


def marked(entry: Entry | None, endian: str) -> bool:
    """Whether an entry is the marker itself, not just any value at its tag."""
    return entry is not None and entry.kind == tiff.LONG and tiff.integers(entry, endian) == [MARKER_VALUE]


def is_compressed(directory: Directory, endian: str) -> bool:
    """Whether this library compressed a directory."""
    return marked(directory.get(MARKER_TAG), endian) and tiff.first(directory, tiff.COMPRESSION, endian, UNCOMPRESSED) == LOSSLESS_JPEG


def geometry(directory: Directory, endian: str) -> Geometry | None:
    """What there is to compress: None for no image or one that is compressed already; raises for an image that
    can't be represented, rather than leaving it out."""
    get = lambda tag, default=None: tiff.first(directory, tag, endian, default)
    if directory.segments is None or get(tiff.COMPRESSION, UNCOMPRESSED) != UNCOMPRESSED:
        return None
    if (planar := get(tiff.PLANAR, 1)) != 1:
        raise FrameError("UnsupportedPlanarConfig", f"PlanarConfiguration is {planar}; samples have to be interleaved (1)")
    bits = tiff.integers(directory.get(tiff.BITS), endian)
    if not bits:
        raise FrameError("MissingTag", f"an image without BitsPerSample (tag {tiff.BITS})")
    if len(set(bits)) > 1:
        raise FrameError("InconsistentBitDepth", "BitsPerSample does not give every component the same depth")
    if bits[0] not in samples.DEPTHS:
        raise FrameError("UnsupportedBitDepth", f"samples of {bits[0]} bits; depths are {samples.DEPTHS}")
    if len(bits) != get(tiff.SAMPLES_PER_PIXEL, 1):
        raise FrameError("InconsistentBitDepth", "BitsPerSample does not give every component the same depth")
    if not 1 <= len(bits) <= 4:
        raise FrameError("UnsupportedComponents", f"{len(bits)} components; a stream takes one to four")
    for tag in (tiff.WIDTH, tiff.LENGTH):
        if get(tag) is None:
            raise FrameError("MissingTag", f"an image without tag {tag}, one of its dimensions")
    return Geometry(bits[0], len(bits), get(tiff.WIDTH), get(tiff.LENGTH))


def segment_size(directory: Directory, found: Geometry, index: int) -> tuple[int, int]:
    """Width and height of a segment: a tile is always whole, the last strip has the rows that are left."""
    if directory.layout == "Tiles":
        size = directory.tile_width, directory.tile_length
    else:
        rows = directory.rows_per_strip
        if not rows:
            raise FrameError("SegmentGeometry", "RowsPerStrip is 0")
        if index * rows >= found.height:
            raise FrameError("SegmentGeometry", f"strip {index} lies below the last of {found.height} rows")
        size = found.width, min(rows, found.height - index * rows)
    for n in size:
        if n > 65535:
            raise FrameError("DimensionTooLarge", f"a side of {n} samples; a stream takes 65535 at most")
    return size


def encode_segment(data: bytes, found: Geometry, width: int, height: int, endian: str) -> bytes:
    """The stream of a segment's pixels, and after it the padding that followed them."""
    row = width * found.components
    if row * found.precision % 8:
        raise FrameError("UnsupportedRowAlignment", f"rows of {row} samples of {found.precision} bits do not end on whole bytes")
    pixels = samples.packed_bytes(row * height, found.precision)
    if len(data) < pixels:
        raise FrameError("SegmentTooShort", f"a segment of {len(data)} bytes where its pixels take {pixels}")
    levels = samples.unpack(data, found.precision, endian, row * height)
    return ljpeg.encode(levels, width, height, found.components, found.precision) + data[pixels:]


def decode_segment(data: bytes, endian: str) -> bytes:
    """Pixels and padding of a segment that encode_segment() made."""
    made = ljpeg.decode(data)
    return samples.pack(made.samples, made.precision, endian) + data[made.consumed :]


def _below_pointer(frame: Frame, k: int) -> bool:
    """Directories that pointers lead to are kept as they are, with all below them."""
    while k >= 0:
        if frame.directories[k].edge == "pointer":
            return True
        k = frame.directories[k].parent
    return False


def compress(frame: Frame) -> Frame:
    """A frame whose uncompressed images are compressed and marked."""
    out, endian = frame.copy(), frame.endian
    images = [d for k, d in enumerate(out.directories) if not _below_pointer(out, k)]
    for directory in images:
        if (entry := directory.get(MARKER_TAG)) and not marked(entry, endian):
            raise FrameError("MarkerCollision", f"tag {MARKER_TAG:#06x}, which marks compressed images, has a value of another origin")
    for directory in reversed(images):
        if (found := geometry(directory, endian)) is None:
            continue
        directory.segments = [encode_segment(x, found, *segment_size(directory, found, k), endian) for k, x in enumerate(directory.segments)]
        directory.put(tiff.make(tiff.COMPRESSION, tiff.SHORT, [LOSSLESS_JPEG], endian))
        directory.put(tiff.make(MARKER_TAG, tiff.LONG, [MARKER_VALUE], endian))
    return out


def decompress(frame: Frame) -> Frame:
    """The inverse of compress(); images that others compressed stay."""
    out, endian = frame.copy(), frame.endian
    for k, directory in enumerate(out.directories):
        if _below_pointer(out, k) or directory.segments is None or not is_compressed(directory, endian):
            continue
        directory.segments = [decode_segment(x, endian) for x in directory.segments]
        directory.put(tiff.make(tiff.COMPRESSION, tiff.SHORT, [UNCOMPRESSED], endian))
        directory.remove(MARKER_TAG)
    return out


def tag_differences(before: dict[int, bytes], after: dict[int, bytes]) -> list[tuple[int, str]]:
    """Tags that were added, removed or changed, in order; those that compression itself sets are left out."""
    kinds = {t: "Added" if t not in before else "Removed" if t not in after else "Changed" for t in before.keys() | after.keys() if before.get(t) != after.get(t)}
    return sorted((t, k) for t, k in kinds.items() if t not in (tiff.COMPRESSION, MARKER_TAG))


def snapshot(directory: Directory, endian: str) -> dict[int, bytes]:
    """Canonical values by tag; of a repeated tag the last one."""
    return {e.tag: tiff.canonical(e, endian) for e in directory.entries}


def verify(before: Frame, after: Frame) -> None:
    """Raise unless `after` holds everything of `before`: the tree, every tag, every byte of every segment."""
    if before.endian != after.endian:
        raise FrameError("RoundTrip", "read back, the file has the other byte order")
    shape = [[(d.parent, d.edge, d.ordinal, d.pointer) for d in f.directories] for f in (before, after)]
    if shape[0] != shape[1]:
        raise FrameError("RoundTrip", "read back, the tree of directories is another one")
    endian = before.endian
    for k, (old, new) in enumerate(zip(before.directories, after.directories, strict=True)):
        if found := tag_differences(snapshot(old, endian), snapshot(new, endian)):
            raise FrameError("TagViolations", f"read back, these tags are not as they were: {found}")
        ours = not _below_pointer(before, k) and old.segments is not None and is_compressed(new, endian) and tiff.first(old, tiff.COMPRESSION, endian, UNCOMPRESSED) == UNCOMPRESSED
        if not ours:
            if old.segments != new.segments or (old.layout, old.rows_per_strip, old.tile_width, old.tile_length) != (new.layout, new.rows_per_strip, new.tile_width, new.tile_length):
                raise FrameError("RoundTrip", "read back, an image that was to stay is another one")
            continue
        if new.segments is None or len(new.segments) != len(old.segments) or (old.layout, old.rows_per_strip, old.tile_width, old.tile_length) != (new.layout, new.rows_per_strip, new.tile_width, new.tile_length):
            raise FrameError("RoundTrip", "read back, an image is cut into other segments")
        for j, (x, y) in enumerate(zip(old.segments, new.segments, strict=True)):
            if decode_segment(y, endian) != x:
                raise FrameError("RoundTrip", f"decoded again, segment {j} has other bytes")


def same(a: Frame, b: Frame) -> bool:
    """Whether two frames hold the same; where a maker note came from does not count."""
    plain = lambda f: [(d.parent, d.edge, d.ordinal, d.pointer, d.entries, d.layout, d.rows_per_strip, d.tile_width, d.tile_length, d.segments) for d in f.directories]
    return a.endian == b.endian and plain(a) == plain(b)


def compress_bytes(data: bytes, check: bool = True) -> bytes:
    """A compressed file from a file; with check, only after the result was read back and proved."""
    frame = tiff.parse(data)
    made = compress(frame)
    if same(frame, made):
        raise FrameError("NothingToCompress", "the frame has no uncompressed image")
    if check:
        verify(frame, made)
    return tiff.serialise(made)


def decompress_bytes(data: bytes) -> bytes:
    frame = tiff.parse(data)
    made = decompress(frame)
    if same(frame, made):
        raise FrameError("NothingToDecompress", "the frame has no image that this library compressed")
    return tiff.serialise(made)


def preview(frame: Frame) -> tuple[bytes, int, int] | None:
    """The largest embedded JPEG (bytes, width, height), the first among equals; directories below pointers have none."""
    best, area = None, 0
    for k, d in enumerate(frame.directories):
        if _below_pointer(frame, k) or d.segments is None or tiff.first(d, tiff.COMPRESSION, frame.endian) not in (6, 7):
            continue
        data = b"".join(d.segments)
        width, height = (tiff.first(d, t, frame.endian, 0) for t in (tiff.WIDTH, tiff.LENGTH))
        if len(data) >= 4 and data[:2] == b"\xff\xd8" and width * height > area:
            best, area = (data, width, height), width * height
    return best
