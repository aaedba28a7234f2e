import struct

import numpy as np
import pytest

from rawloom.functions import blake3, codec, develop, inspect, ljpeg, samples, tiff
from rawloom.functions.errors import CODEC, CONTAINER, FrameError
from tests import frames_data as made

EDGES = [(1, 1, 1, 16, [40000]), (16, 1, 1, 8, range(16)), (1, 16, 1, 8, range(16)), (8, 8, 1, 12, [0] * 64), (8, 8, 1, 16, [65535] * 64), (4, 4, 1, 2, [3, 0] * 8), (3, 2, 3, 10, range(18)), (2, 2, 4, 14, range(16)), (2, 1, 1, 16, [0, 32768]), (3, 1, 1, 16, [32768, 0, 32768])]


@pytest.mark.parametrize("case", EDGES)
def test_codec_edges(case):
    w, h, c, p, levels = case
    stream = ljpeg.encode(np.array(levels), w, h, c, p)
    back = ljpeg.decode(stream + b"trailing")
    assert back.samples.tolist() == list(levels) and (back.width, back.height, back.components, back.precision, back.consumed) == (w, h, c, p, len(stream))


def test_codec_random():
    rng = np.random.default_rng(1)
    for _ in range(150):
        w, h, c, p = int(rng.integers(1, 65)), int(rng.integers(1, 33)), int(rng.integers(1, 5)), int(rng.integers(2, 17))
        n = w * h * c
        kind = rng.integers(3)
        levels = rng.integers(0, 1 << p, n) if kind == 0 else np.clip(rng.normal((1 << p) / 2, 2, n), 0, (1 << p) - 1).astype(int) if kind == 1 else np.arange(n) % (1 << p)
        stream = ljpeg.encode(levels, w, h, c, p)
        assert (ljpeg.decode(stream).samples == levels).all()
        for cut in {2, len(stream) // 2, len(stream) - 2, len(stream) - 1}:
            with pytest.raises(FrameError):
                ljpeg.decode(stream[:cut])
        damaged = bytearray(stream)
        damaged[int(rng.integers(len(damaged)))] ^= 1 << int(rng.integers(8))
        try:
            ljpeg.decode(bytes(damaged))
        except FrameError as e:
            assert e.code in CODEC


def test_codec_refuses():
    good = ljpeg.encode(np.arange(4), 2, 2, 1, 8)
    for args, code in (((np.arange(4), 2, 2, 0, 8), "InvalidComponents"), ((np.arange(4), 2, 2, 1, 17), "InvalidPrecision"), ((np.arange(4), 0, 2, 1, 8), "InvalidDimensions"), ((np.arange(5), 2, 2, 1, 8), "SampleCountMismatch"), ((np.array([256, 0, 0, 0]), 2, 2, 1, 8), "SampleOutOfRange")):
        with pytest.raises(FrameError) as e:
            ljpeg.encode(*args)
        assert e.value.code == code
    for data, code in ((b"", "UnexpectedEof"), (b"\0\0", "InvalidMarker"), (good[:2] + b"\xff\xe0" + good[2:], "UnsupportedMarker"), (good[:-2] + b"\xff\xda", "InvalidMarker")):
        with pytest.raises(FrameError) as e:
            ljpeg.decode(data)
        assert e.value.code == code


def test_codes():
    assert ljpeg.code_lengths([0] * 5 + [9] + [0] * 11)[5] == 1
    rng = np.random.default_rng(2)
    for _ in range(300):
        histogram = [int(x) for x in rng.integers(0, 30, 17) * rng.integers(0, 2, 17)]
        lengths = ljpeg.code_lengths(histogram)
        codes = ljpeg.canonical_codes(lengths)
        words = [format(c, f"0{n}b") for c, n in zip(codes, lengths, strict=True) if n]
        assert [bool(n) for n in lengths] == [bool(n) for n in histogram] and all("0" in w for w in words)
        assert not any(a != b and b.startswith(a) for a in words for b in words)
    skewed = [1 << k for k in range(17)]
    assert max(ljpeg.code_lengths(skewed)) <= 16


def test_size_from_the_histogram():
    levels = (np.arange(64 * 64) // 7) % 4096
    d = ljpeg.residuals(levels.astype(np.uint16).reshape(64, 64, 1), 12)
    bits = ljpeg.encoded_bits(np.bincount(ljpeg.categories(d).ravel(), minlength=17).tolist())
    stream = ljpeg.encode(levels, 64, 64, 1, 12)
    entropy = stream[stream.index(b"\xff\xda") + 10 : -2].replace(b"\xff\0", b"\xff")
    assert len(entropy) == -(-bits // 8) and (ljpeg.restore(d, 12).ravel() == levels).all()


def test_unpack_vectors():
    data = bytes.fromhex("34127856")
    assert samples.unpack(data, 16, "Little", 2).tolist() == [0x1234, 0x5678] and samples.unpack(data, 16, "Big", 2).tolist() == [0x3412, 0x7856]
    for endian in ("Little", "Big"):
        assert samples.unpack(bytes.fromhex("102103ffff"), 12, endian, 2).tolist() == [0x102, 0x103]
        assert samples.pack(np.array([0x102, 0x103]), 12, endian) == bytes.fromhex("102103")
    rng = np.random.default_rng(3)
    for depth in samples.DEPTHS:
        levels = rng.integers(0, 1 << depth, 37)
        assert (samples.unpack(samples.pack(levels, depth, "Big"), depth, "Big", 37) == levels).all()
    for call, code in ((lambda: samples.unpack(b"", 8, "Big", 1), "SegmentTooShort"), (lambda: samples.unpack(b"", 11, "Big", 0), "UnsupportedBitDepth"), (lambda: samples.pack(np.array([1024]), 10, "Big"), "SampleOutOfRange")):
        with pytest.raises(FrameError) as e:
            call()
        assert e.value.code == code


@pytest.mark.parametrize("endian", ["Little", "Big"])
@pytest.mark.parametrize("frame", [made.gradient, made.tiled, made.rich])
def test_tree_round_trip(endian, frame):
    one = frame(endian)
    data = tiff.serialise(one)
    again = tiff.parse(data)
    moved = [e.raw for d in again.directories for e in d.entries if e.tag == 37500]
    for d in one.directories + again.directories:
        d.entries = [e for e in d.entries if e.tag != 37500]
    assert codec.same(one, again)
    assert tiff.serialise(tiff.parse(data)) == data
    if moved:
        at = data.index(moved[0])
        assert struct.unpack_from(tiff.order(endian) + "I", moved[0], 20)[0] == at + 30


def test_minimal_file():
    data = bytes.fromhex("49492a0008000000 0200 0001 0300 01000000 08000000 0f01 0200 03000000 48690000 00000000".replace(" ", ""))
    frame = tiff.parse(data)
    assert [(e.tag, e.kind, e.raw[:3]) for e in frame.directories[0].entries] == [(256, 3, b"\x08\0"), (271, 2, b"Hi\0")]


def test_damaged_files():
    data = tiff.serialise(made.rich())
    for cut in range(len(data)):
        try:
            tiff.parse(data[:cut])
        except FrameError as e:
            assert e.code in CONTAINER
    for bad, code in ((b"XX*\0\x08\0\0\0", "BadByteOrder"), (b"II+\0\x08\0\0\0", "BadMagic"), (b"I", "Truncated")):
        with pytest.raises(FrameError) as e:
            tiff.parse(bad)
        assert e.value.code == code
    # A directory that is its own child, and a chain that comes back.
    child = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HHHIII", 1, 330, 4, 1, 8, 0)
    with pytest.raises(FrameError) as e:
        tiff.parse(child)
    assert e.value.code == "TooDeep"
    chain = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HHHIII", 1, 256, 4, 1, 8, 8)
    assert len(tiff.parse(chain).directories) == 1


def test_notes_stay_unless_they_are_sure():
    raw = made.note("Little")
    assert tiff.shift_note(raw, "Little", 1000, 1100) != raw and tiff.shift_note(raw, "Little", 1000, 1000) == raw
    for other in (b"OTHER" + raw[5:], raw[:20], raw[:20] + struct.pack("<I", 5) + raw[24:]):
        assert tiff.shift_note(other, "Little", 1000, 1100) == other


def test_values():
    for kind, elements in ((1, [1, 255]), (3, [1, 65535]), (4, [1 << 31]), (6, [-1]), (8, [-2]), (9, [-3]), (11, [0.5]), (12, [1e300])):
        little, big = (tiff.make(9, kind, elements, e) for e in ("Little", "Big"))
        assert tiff.values(little, "Little").tolist() == elements == tiff.values(big, "Big").tolist()
        assert tiff.canonical(little, "Little") == tiff.canonical(big, "Big")
    assert tiff.numbers(tiff.make(9, 5, [[1, 2], [3, 0]], "Big"), "Big") == [0.5, 0.0] and tiff.numbers(tiff.make(9, 2, b"x", "Big"), "Big") == []


@pytest.mark.parametrize("endian", ["Little", "Big"])
def test_compress_round_trip(endian):
    rng = np.random.default_rng(5)
    cases = [made.gradient(endian), made.tiled(endian), made.rich(endian)]
    for depth in samples.DEPTHS:
        for c in (1, 2, 3, 4):
            cases.append(tiff.Frame(endian, [made.raw_directory(rng.integers(0, 1 << depth, 8 * 5 * c), 8, 5, depth, c, endian, rng.bytes(int(rng.integers(4))), rows=2)]))
    for frame in cases:
        data = tiff.serialise(frame)
        packed = codec.compress_bytes(data)
        assert codec.decompress_bytes(packed) == data and codec.compress_bytes(codec.decompress_bytes(packed)) == packed
        with pytest.raises(FrameError) as e:
            codec.compress_bytes(packed)
        assert e.value.code == "NothingToCompress"
    with pytest.raises(FrameError) as e:
        codec.decompress_bytes(data)
    assert e.value.code == "NothingToDecompress"


def test_known_bytes_of_12_bits():
    d = made.raw_directory([0x102, 0x103], 2, 1, 12, tail=b"\xab\xcd\xef")
    assert d.segments == [bytes.fromhex("102103abcdef")]
    packed = codec.compress(tiff.Frame("Little", [d]))
    assert packed.directories[0].segments[0].endswith(b"\xff\xd9\xab\xcd\xef")


def test_what_cannot_be_compressed():
    def error(change, **other):
        d = made.raw_directory(np.zeros(64), 8, 8, **other)
        change(d)
        with pytest.raises(FrameError) as e:
            codec.compress(tiff.Frame("Little", [d]))
        return e.value.code

    put = lambda t, k, v: lambda d: d.put(tiff.make(t, k, v, "Little"))
    assert error(put(258, 3, [11])) == "UnsupportedBitDepth"
    assert error(put(258, 3, [16, 8])) == "InconsistentBitDepth"
    assert error(put(277, 3, [3])) == "InconsistentBitDepth"
    assert error(put(284, 3, [2])) == "UnsupportedPlanarConfig"
    assert error(lambda d: d.remove(258)) == "MissingTag"
    assert error(lambda d: d.remove(257)) == "MissingTag"
    assert error(put(codec.MARKER_TAG, 3, [42])) == "MarkerCollision"
    assert error(put(258, 3, [16] * 5)) == "InconsistentBitDepth"
    assert error(lambda d: d.segments.append(d.segments[0])) == "SegmentGeometry"
    assert error(lambda d: setattr(d, "segments", [b""])) == "SegmentTooShort"
    assert error(put(256, 4, [70000])) == "DimensionTooLarge"
    assert error(lambda d: (put(258, 3, [12])(d), put(256, 4, [3])(d))) == "UnsupportedRowAlignment"


def test_tampering_is_found():
    before = made.rich()
    for change, code in (
        (lambda f: f.directories[1].segments.__setitem__(0, f.directories[1].segments[1]), "RoundTrip"),
        (lambda f: f.directories[1].put(tiff.make(0x9000, 2, b"other\0", "Little")), "TagViolations"),
        (lambda f: f.directories[0].segments.__setitem__(0, b"x"), "RoundTrip"),
        (lambda f: f.directories.pop(), "RoundTrip"),
        (lambda f: f.directories[2].remove(33434), "TagViolations"),
        (lambda f: setattr(f, "endian", "Big"), "RoundTrip"),
    ):
        after = codec.compress(before)
        codec.verify(before, after)
        change(after)
        with pytest.raises(FrameError) as e:
            codec.verify(before, after)
        assert e.value.code == code


def test_tag_differences():
    assert codec.tag_differences({256: b"a", 259: b"x", 320: b"c"}, {256: b"b", 259: b"y", 700: b"d"}) == [(256, "Changed"), (320, "Removed"), (700, "Added")]


def test_preview():
    frame = made.rich()
    assert codec.preview(frame) == (b"\xff\xd8jpeg\xff\xd9", 4, 2)
    frame.directories[0].segments = [b"nojpeg"]
    assert codec.preview(frame) is None and codec.preview(made.gradient()) is None


def test_develop_vectors():
    def show(levels, **other):
        p = develop.Parameters(2, 2, 12, np.zeros(4, np.float32), 4095.0, (0, 1, 1, 2), np.ones(3, np.float32), 1.0, None)
        return develop.develop(np.array(levels), p, **other)[0, 0].tolist()

    assert show([4095] * 4) == [255] * 4 and show([0] * 4) == [0, 0, 0, 255]
    grey = show([2047] * 4)
    assert 185 <= grey[0] <= 191 and grey[0] == grey[1] == grey[2]
    colour = show([4095, 2047, 2047, 0])
    assert colour[0] == 255 and colour[2] == 0
    assert show([2047] * 4, name="rec709")[0] < grey[0]


def test_develop_parameters():
    extra = ((262, 3, [32803]), (33422, 1, bytes([0, 1, 1, 2])), (50717, 4, [4095]), (50714, 3, [256]), (50728, 5, [[1, 2], [1, 1], [3, 4]]), (50730, 10, [[1, 1]]))
    frame = tiff.Frame("Little", [made.raw_directory(np.zeros(8), 4, 2, 12, rows=1, tail=b"z", extra=extra)])
    p, packed = develop.largest(frame)
    assert p.black.tolist() == [256] * 4 and p.white == 4095 and p.neutral.tolist() == [0.5, 1, 0.75] and p.exposure == 2 and p.matrix is None and len(packed) == 12
    pixels, w, h = develop.render(frame)
    assert pixels.shape == (2, 4, 4) and (w, h) == (4, 2)
    assert develop.render(made.tiled()) is None
    m = np.array([[2, 0, 0], [0, 4, 1], [0, 0, 1]], np.float32)
    assert np.allclose(develop.invert(m) @ m, np.eye(3), atol=1e-6) and develop.invert(np.ones((3, 3))) is None


def test_demosaic_by_hand():
    rng = np.random.default_rng(7)
    linear = rng.random((5, 4)).astype(np.float32)
    got = develop.demosaic(linear, (0, 1, 1, 2))
    for y in range(5):
        for x in range(4):
            near = [(linear[j, i], (0, 1, 1, 2)[j % 2 * 2 + i % 2]) for j in range(max(0, y - 1), min(5, y + 2)) for i in range(max(0, x - 1), min(4, x + 2))]
            for c in range(3):
                own = [v for v, k in near if k == c]
                assert got[y, x, c] == pytest.approx(np.mean(own) if own else 0, rel=1e-5)


#: Published test vectors: input bytes count up modulo 251.
HASHES = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030", 31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"}


@pytest.mark.parametrize("n", HASHES)
def test_blake3(n, monkeypatch):
    data = bytes(k % 251 for k in range(n))
    assert blake3.blake3(data) == HASHES[n]
    monkeypatch.setattr(blake3.Blake3, "STEP", 4)
    state = blake3.Blake3()
    for k in range(0, n, 1000):
        state.update(data[k : k + 1000])
    assert state.hexdigest() == HASHES[n]


def test_blake3_of_many():
    inputs = [bytes(k % 251 for k in range(n)) for n in HASHES] + [b"", bytes(5000), bytes(range(256)) * 13]
    assert blake3.blake3_many(inputs) == [blake3.blake3(x) for x in inputs] and blake3.blake3_many([]) == []


def _tiff(mark, big, fields, at=None):
    """A file of one directory of (tag, type, count, value) fields, and what follows."""
    if big:
        head = (b"II" if mark == "<" else b"MM") + struct.pack(mark + "HHHQ", 43, 8, 0, 16)
        return head + struct.pack(mark + "Q", len(fields)) + b"".join(struct.pack(mark + "HHQ", t, k, n) + v.ljust(8, b"\0") for t, k, n, v in fields) + bytes(8)
    head = (b"II" if mark == "<" else b"MM") + struct.pack(mark + "HI", 42, 8)
    return head + struct.pack(mark + "H", len(fields)) + b"".join(struct.pack(mark + "HHI", t, k, n) + v.ljust(4, b"\0") for t, k, n, v in fields) + bytes(4)


def test_inspect():
    for mark, name in (("<", "little-endian"), (">", "big-endian")):
        for big in (False, True):
            data = _tiff(mark, big, [(256, 3, 1, struct.pack(mark + "H", 640)), (257, 3, 1, struct.pack(mark + "H", 480)), (271, 2, 2, b"x\0")])
            assert inspect.look(data) == {"byte_order": name, "big_tiff": big, "width": 640, "height": 480, "tag_count": 3}
    small = [(256, 4, 1, struct.pack("<I", 160)), (257, 4, 1, struct.pack("<I", 120))]
    first = _tiff("<", False, [*small, (330, 4, 1, struct.pack("<I", 50))])
    assert len(first) == 50
    sub = struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 6000) + struct.pack("<HHII", 257, 4, 1, 4000) + bytes(4)
    assert (inspect.look(first + sub)["width"], inspect.look(first + sub)["height"]) == (6000, 4000)
    assert inspect.look(first)["width"] == 160
    for bad in (b"", b"II", b"garbage bytes", b"II*\0\xff\xff\0\0", b"II+\0\x04\0\0\0" + bytes(8)):
        assert inspect.look(bad) is None
