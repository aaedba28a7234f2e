"""Whole runs over files: compress, decompress, offload, inspect, preview and render."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawloom.functions import codec, develop, inspect, tiff
from rawloom.functions.blake3 import Blake3, blake3
from rawloom.functions.columns import detect_format, ratio
from rawloom.functions.errors import FrameError
from rawloom.operators import compare
from rawloom.session import materialise, ship
from rawloom.sources import frames

STATS = "ord int, input string, output string, input_bytes long, output_bytes long, error_code string, error string"
#: Bytes of a file that are hashed or copied at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class CompressOptions:
    verify: bool = True


def write_atomically(path: str, data: bytes) -> None:
    """Write beside the target, then rename: a task that is tried again or lost leaves no half file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def transform_frames(spark: SparkSession, source: str, out: str, change: Callable[[bytes], bytes]) -> DataFrame:
    """Run a function of bytes over the frames of a file or folder into the folder `out`, on the executors.

    Returns one row of STATS for each frame.  Like any run over files this is eager: the frames are written once,
    and the rows that come back are sizes.  Output that would replace its own input is refused."""
    files = frames.resolve(source)
    os.makedirs(out, exist_ok=True)
    for path in files:
        if os.path.exists(at := os.path.join(out, os.path.basename(path))) and os.path.samefile(path, at):
            raise FrameError("InPlace", f"the output folder holds the input {path}")
    ship(spark)
    listed = spark.createDataFrame([(k, p, os.path.join(out, os.path.basename(p))) for k, p in enumerate(files)], "ord int, input string, output string")
    listed = listed.repartition(min(len(files), 4096))

    def one(row: dict) -> dict:
        try:
            with open(row["input"], "rb") as f:
                data = f.read()
            made = change(data)
            write_atomically(row["output"], made)
            return row | {"input_bytes": len(data), "output_bytes": len(made), "error_code": None, "error": None}
        except FrameError as e:
            return row | {"input_bytes": 0, "output_bytes": 0, "error_code": e.code, "error": e.message}
        except OSError as e:
            return row | {"input_bytes": 0, "output_bytes": 0, "error_code": "Io", "error": f"i/o error at {e.filename}: {e.strerror}"}

    schema = pa.schema([("ord", pa.int32()), ("input", pa.string()), ("output", pa.string()), ("input_bytes", pa.int64()), ("output_bytes", pa.int64()), ("error_code", pa.string()), ("error", pa.string())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([one(row)], schema=schema)

    done = listed.mapInArrow(kernel, STATS).collect()
    return spark.createDataFrame(sorted(done, key=lambda r: r["ord"]), STATS)


def _checked(stats: DataFrame) -> DataFrame:
    """The statistics, or the error of the first frame that has one."""
    if failed := stats.where("error_code is not null").orderBy("ord").first():
        raise FrameError(failed["error_code"], f"{failed['input']}: {failed['error']}")
    return stats.drop("ord", "error_code", "error").withColumn("ratio", ratio(F.col("output_bytes"), F.col("input_bytes")))


def compress(spark: SparkSession, source: str, out: str, options: CompressOptions | None = None) -> DataFrame:
    """Compress frames; verified before they are written unless the options say otherwise."""
    check = (options or CompressOptions()).verify
    return _checked(transform_frames(spark, source, out, lambda data: codec.compress_bytes(data, check)))


def decompress(spark: SparkSession, source: str, out: str) -> DataFrame:
    return _checked(transform_frames(spark, source, out, codec.decompress_bytes))


def verify_roundtrip(data: bytes) -> None:
    """Raise unless compressing and reading back proves lossless."""
    frame = tiff.parse(data)
    codec.verify(frame, codec.compress(frame))


def idempotent(data: bytes) -> bool:
    """Whether compressing the decompressed file gives the same compressed file."""
    made = codec.compress_bytes(data)
    return codec.compress_bytes(codec.decompress_bytes(made)) == made


def hash_file(path: str) -> tuple[str, int]:
    """BLAKE3 and size of a file, read piece by piece."""
    state, size = Blake3(), 0
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            state.update(piece)
            size += len(piece)
    return state.hexdigest(), size


def copy_verified(source: str, target: str, digest: str) -> tuple[str, str | None]:
    """Copy a file, read the copy back and compare; (status, error)."""
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            shutil.copyfile(source, part)
            os.replace(part, target)
        finally:
            if os.path.exists(part):
                os.remove(part)
        return ("Verified", None) if hash_file(target)[0] == digest else ("ChecksumMismatch", None)
    except OSError as e:
        return "Error", f"i/o error at {e.filename}: {e.strerror}"


COPIES = "source string, relative string, size long, checksum string, error string, destination string, status string, status_error string"


def offload(spark: SparkSession, source: str, destinations: list[str]) -> DataFrame:
    """Copy a file or folder to every destination and verify each copy; one row for each file and destination.

    A file that can't be read has one row, with an error and no destination.  Errors stay in the report."""
    if not destinations:
        raise FrameError("NoDestinations", "an offload needs one target folder at least")
    files = frames.walk(source)
    ship(spark)
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in COPIES.split(", ")])

    def rows(path: str, relative: str) -> Iterator[dict]:
        own = {"source": path, "relative": relative, "size": 0, "checksum": None, "error": None, "destination": None, "status": None, "status_error": None}
        try:
            digest, size = hash_file(path)
        except OSError as e:
            yield own | {"error": f"i/o error at {path}: {e.strerror}"}
            return
        for d in destinations:
            status, error = copy_verified(path, target := os.path.join(d, relative), digest)
            yield own | {"size": size, "checksum": digest, "destination": target, "status": status, "status_error": error}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(rows(row["path"], row["relative"])), schema=schema)

    done = frames.manifest(spark, files).select("path", "relative").mapInArrow(kernel, COPIES).collect()
    return spark.createDataFrame(sorted(done, key=lambda r: (r["relative"].split("/"), r["destination"] or "")), COPIES)


def offload_report(copies: DataFrame) -> DataFrame:
    return compare.offload_totals(compare.file_outcomes(copies))


FACTS = "path string, bytes long, checksum string, byte_order string, big_tiff boolean, width long, height long, tag_count long"


def inspect_frames(contents: DataFrame) -> DataFrame:
    """Facts of files (path, content): size, BLAKE3, format and what a tolerant parser sees."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = inspect.look(data) or dict.fromkeys(("byte_order", "big_tiff", "width", "height", "tag_count"))
                rows.append((path, len(data), blake3(data), *seen.values()))
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in FACTS.split(", ")])

    found = contents.where("content is not null").select("path", "content").mapInArrow(kernel, FACTS)
    return found.withColumn("format", detect_format("path", F.col("tag_count").isNotNull()))


def renditions(contents: DataFrame, curve: str = "srgb") -> DataFrame:
    """(path, kind, width, height, image): the developed mosaic of a frame, else its preview JPEG, else nothing."""

    def one(data: bytes) -> tuple:
        try:
            frame = tiff.parse(data)
            if made := develop.render(frame, curve):
                return "developed", made[1], made[2], made[0].tobytes()
            if found := codec.preview(frame):
                return "preview", found[1], found[2], found[0]
        except FrameError as e:
            return e.code, None, None, None
        return None, None, None, None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array([path]), *(pa.array([v], t) for v, t in zip(one(data), types, strict=True))], names=["path", "kind", "width", "height", "image"])

    return contents.where("content is not null").select("path", "content").mapInArrow(kernel, "path string, kind string, width long, height long, image binary")


def map_contents(contents: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """(path, content, error_code, error): a function of bytes over a table of files."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    row = (change(data or b""), None, None)
                except FrameError as e:
                    row = (None, e.code, e.message)
                yield pa.record_batch([pa.array([path]), *(pa.array([v], t) for v, t in zip(row, (pa.binary(), pa.string(), pa.string()), strict=True))], names=["path", "content", "error_code", "error"])

    return contents.select("path", "content").mapInArrow(kernel, "path string, content binary, error_code string, error string")


PLAN = "path string, ifd_id int, precision int, components int, endian string, sizes array<struct<width:int,height:int>>, error_code string, error string"
CODED = "path string, ifd_id int, seg_index int, coded binary, error_code string, error string"
KEYS = ["path", "ifd_id", "seg_index"]


def _plan_rows(frame: tiff.Frame, forward: bool) -> list[dict]:
    """What has to be coded: for each directory of a frame that is concerned the shape of its segments."""
    out = []
    for k, d in enumerate(frame.directories):
        if codec._below_pointer(frame, k):
            continue
        if forward and (entry := d.get(codec.MARKER_TAG)) and not codec.marked(entry, frame.endian):
            raise FrameError("MarkerCollision", f"tag {codec.MARKER_TAG:#06x}, which marks compressed images, has a value of another origin")
        if forward:
            if found := codec.geometry(d, frame.endian):
                sizes = [codec.segment_size(d, found, i) for i in range(len(d.segments))]
                out.append({"ifd_id": k, "precision": found.precision, "components": found.components, "sizes": [{"width": w, "height": h} for w, h in sizes]})
        elif d.segments is not None and codec.is_compressed(d, frame.endian):
            out.append({"ifd_id": k, "precision": 0, "components": 0, "sizes": [{"width": 0, "height": 0}] * len(d.segments)})
    if not out:
        raise FrameError("NothingToCompress", "the frame has no uncompressed image") if forward else FrameError("NothingToDecompress", "the frame has no image that this library compressed")
    return [r | {"endian": frame.endian} for r in out]


def code_segments(contents: DataFrame, forward: bool = True) -> DataFrame:
    """(path, content, error_code, error): frames compressed (or decompressed), each segment in a task of its own choosing.

    Frames are parsed into directories and segments; one row for each segment is dealt by path, directory and place,
    coded, and when compressing decoded again and compared; the results are joined back on the same keys and a file is put
    together from its directories.  So one large frame keeps all cores busy.  The bytes are those of
    codec.compress_bytes() and codec.decompress_bytes()."""
    ship(contents.sparkSession)
    directories = materialise(frames.parse(contents))
    good = directories.where("error_code is null")
    bare = good.withColumn("segments", F.transform("segments", lambda _: F.lit(b"")))
    plan_schema = pa.schema([("path", pa.string()), ("ifd_id", pa.int32()), ("precision", pa.int32()), ("components", pa.int32()), ("endian", pa.string()), ("sizes", pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32())]))), ("error_code", pa.string()), ("error", pa.string())])

    def plan(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        try:
            made = [{"path": rows[0]["path"], **r} for r in _plan_rows(frames.frame_of(rows), forward)]
        except FrameError as e:
            made = [{"path": rows[0]["path"], "error_code": e.code, "error": e.message}]
        return pa.Table.from_pylist(made, schema=plan_schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("ifd_id", pa.int32()), ("seg_index", pa.int32()), ("coded", pa.binary()), ("error_code", pa.string()), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = {c: row[c] for c in KEYS}
                try:
                    data, endian = bytes(row["bytes"]), row["endian"]
                    if forward:
                        out["coded"] = codec.encode_segment(data, codec.Geometry(row["precision"], row["components"], 0, 0), row["width"], row["height"], endian)
                        if codec.decode_segment(out["coded"], endian) != data:
                            raise FrameError("RoundTrip", f"decoded again, segment {row['seg_index']} has other bytes")
                    else:
                        out["coded"] = codec.decode_segment(data, endian)
                except FrameError as e:
                    out |= {"coded": None, "error_code": e.code, "error": e.message}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ifd_id"])
        frame = frames.frame_of(rows)
        for d, row in zip(frame.directories, rows, strict=True):
            if row["coded_here"] and forward:
                d.put(tiff.make(tiff.COMPRESSION, tiff.SHORT, [codec.LOSSLESS_JPEG], frame.endian))
                d.put(tiff.make(codec.MARKER_TAG, tiff.LONG, [codec.MARKER_VALUE], frame.endian))
            elif row["coded_here"]:
                d.put(tiff.make(tiff.COMPRESSION, tiff.SHORT, [codec.UNCOMPRESSED], frame.endian))
                d.remove(codec.MARKER_TAG)
        return pa.table({"path": pa.array([rows[0]["path"]], pa.string()), "content": pa.array([tiff.serialise(frame)], pa.binary())})

    plans = materialise(bare.groupBy("path").applyInArrow(plan, PLAN))
    segments = frames.segments(good)
    shape = F.get("sizes", F.col("seg_index"))
    jobs = segments.join(plans.where("error_code is null"), ["path", "ifd_id"]).select(*KEYS, "bytes", "precision", "components", "endian", shape["width"].alias("width"), shape["height"].alias("height"))
    coded = materialise(jobs.repartition(*KEYS).mapInArrow(code, CODED))
    errors = directories.where("error_code is not null").select("path", "error_code", "error").unionAll(plans.where("error_code is not null").select("path", "error_code", "error"))
    first = F.min(F.struct("ifd_id", "seg_index", "error_code", "error")).alias("e")
    errors = errors.unionAll(coded.where("error_code is not null").groupBy("path").agg(first).select("path", "e.error_code", "e.error"))
    whole = segments.join(coded.where("error_code is null").drop("error_code", "error"), KEYS, "left").select(*KEYS, F.coalesce("coded", "bytes").alias("bytes"))
    lists = whole.groupBy("path", "ifd_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "bytes"))), lambda s: s["bytes"]).alias("made"))
    changed = plans.where("error_code is null").select("path", "ifd_id", F.lit(True).alias("coded_here"))
    joined = good.join(lists, ["path", "ifd_id"], "left").join(changed, ["path", "ifd_id"], "left").join(errors.select("path"), "path", "left_anti")
    joined = joined.withColumn("segments", F.when(F.col("segments").isNotNull(), F.coalesce("made", "segments"))).drop("made")
    files = joined.groupBy("path").applyInArrow(finish, "path string, content binary")
    nothing = F.lit(None).cast("string")
    return files.select("path", "content", nothing.alias("error_code"), nothing.alias("error")).unionAll(errors.select("path", F.lit(None).cast("binary").alias("content"), "error_code", "error"))


def verify_segments(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, ifd_id, seg_index): segments of parsed frames (path, ifd_id, seg_index, bytes) that are not the same, or are on
    one side alone."""
    a, b = before.withColumnRenamed("bytes", "a"), after.withColumnRenamed("bytes", "b")
    return a.join(b, KEYS, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*KEYS)
