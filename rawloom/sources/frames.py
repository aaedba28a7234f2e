"""Where frames come from: manifests of files, and the four tables of parsed frames."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawloom.functions import tiff
from rawloom.functions.errors import FrameError
from rawloom.session import ship

MANIFEST = "path string, relative string, size long"
#: One row for each directory of a frame, or one with an error.
ELEMENTS = "struct<tag:int,type_code:int,count:long,ord:int,raw:binary,canon:binary,ints:array<long>,numbers:array<float>>"
DIRECTORIES = f"path string, endian string, ifd_id int, parent_id int, edge string, ordinal int, pointer_tag int, note_origin long, layout string, rows_per_strip long, tile_width long, tile_length long, entries array<{ELEMENTS}>, segments array<binary>, error_code string, error string"


def _by_component(relative: str) -> list[str]:
    return relative.split("/")


def _is_frame(name: str) -> bool:
    return name.lower().endswith(".dng") and name.lower() != ".dng"


def list_frames(folder: str) -> list[str]:
    """The frames right inside a folder, by path; links don't count as files."""
    with os.scandir(folder) as found:
        return sorted((e.path for e in found if e.is_file(follow_symlinks=False) and _is_frame(e.name)), key=_by_component)


def resolve(path: str) -> list[str]:
    """A file by itself, or the frames of a folder; links are followed here."""
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FrameError("NotFileOrDir", f"{path}: nothing there that can be read as a file or folder")
    found = list_frames(path)
    if not found:
        raise FrameError("NoFrames", f"{path}: the folder holds no file that ends in .dng")
    return found


def walk(root: str) -> list[tuple[str, str]]:
    """(path, relative path) of every file below a root, hidden ones included, links not; by relative path."""
    if os.path.isfile(root):
        return [(root, os.path.basename(root))]
    if not os.path.isdir(root):
        raise FrameError("NotFileOrDir", f"{root}: nothing there that can be read as a file or folder")
    out = []
    for at, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not os.path.islink(os.path.join(at, f))]
        out += [(p, os.path.relpath(p, root)) for n in names if os.path.isfile(p := os.path.join(at, n)) and not os.path.islink(p)]
    return sorted(out, key=lambda x: _by_component(x[1]))


def manifest(spark: SparkSession, files: list[tuple[str, str]], per_task: int = 16) -> DataFrame:
    """Files as a table dealt over tasks: names and sizes alone, the bytes are read where they are used."""
    ship(spark)
    rows = [(p, r, os.path.getsize(p) if os.path.exists(p) else None) for p, r in files]
    df = spark.createDataFrame(rows, MANIFEST)
    return df.repartition(max(1, -(-len(rows) // per_task)), "path") if rows else df


def read_contents(files: DataFrame) -> DataFrame:
    """manifest plus content; a file that can't be read has none and an error."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                try:
                    with open(row.column(0)[0].as_py(), "rb") as f:
                        found = [f.read(), None]
                except OSError as e:
                    found = [None, f"i/o error: {e.strerror}"]
                yield pa.record_batch([*row.columns, pa.array([found[0]], pa.binary()), pa.array([found[1]], pa.string())], names=[*row.schema.names, "content", "error"])

    return files.select("path", "relative", "size").mapInArrow(kernel, f"{MANIFEST}, content binary, error string")


def directory_rows(path: str, data: bytes | None) -> list[dict]:
    """The rows of a frame; one row with an error for what can't be parsed."""
    blank = dict.fromkeys(x.split()[0] for x in ("endian", "ifd_id", "parent_id", "edge", "ordinal", "pointer_tag", "note_origin", "layout", "rows_per_strip", "tile_width", "tile_length", "entries", "segments", "error_code", "error"))
    try:
        frame = tiff.parse(data or b"")
    except FrameError as e:
        return [blank | {"path": path, "error_code": e.code, "error": e.message}]
    out = []
    for k, d in enumerate(frame.directories):
        entries = [{"tag": e.tag, "type_code": e.kind, "count": e.count, "ord": j, "raw": e.raw, "canon": tiff.canonical(e, frame.endian), "ints": tiff.integers(e, frame.endian), "numbers": tiff.numbers(e, frame.endian)} for j, e in enumerate(d.entries)]
        out.append(blank | {"path": path, "endian": frame.endian, "ifd_id": k, "parent_id": d.parent, "edge": d.edge, "ordinal": d.ordinal, "pointer_tag": d.pointer, "note_origin": d.note_origin, "layout": d.layout, "rows_per_strip": d.rows_per_strip, "tile_width": d.tile_width, "tile_length": d.tile_length, "entries": entries, "segments": d.segments})
    return out


def parse(frames: DataFrame) -> DataFrame:
    """Directories of frames (path, content); a frame's rows come out one batch at a time."""
    schema = frames.sparkSession.createDataFrame([], DIRECTORIES).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(directory_rows(path, data), schema=to_arrow_schema(schema))

    return frames.select("path", "content").mapInArrow(kernel, DIRECTORIES)


def ifds(directories: DataFrame) -> DataFrame:
    return directories.where("error_code is null").drop("entries", "segments", "error_code", "error")


def entries(directories: DataFrame) -> DataFrame:
    """(path, ifd_id, tag, type_code, count, ord, raw, canon, ints, numbers)."""
    return directories.select("path", "ifd_id", F.explode("entries").alias("e")).select("path", "ifd_id", "e.*")


def segments(directories: DataFrame) -> DataFrame:
    """(path, ifd_id, seg_index, bytes)."""
    return directories.select("path", "ifd_id", F.posexplode("segments").alias("seg_index", "bytes"))


def errors(directories: DataFrame) -> DataFrame:
    return directories.where("error_code is not null").select("path", "error_code", "error")


def frame_of(rows: list[dict]) -> tiff.Frame:
    """A frame from its directory rows."""
    rows = sorted(rows, key=lambda r: r["ifd_id"])
    made = []
    for r in rows:
        kept = [tiff.Entry(e["tag"], e["type_code"], e["count"], bytes(e["raw"])) for e in sorted(r["entries"], key=lambda e: e["ord"])]
        parts = None if r["segments"] is None else [bytes(x) for x in r["segments"]]
        made.append(tiff.Directory(r["parent_id"], r["edge"], r["ordinal"], r["pointer_tag"], kept, r["layout"], r["rows_per_strip"], r["tile_width"], r["tile_length"], parts, r["note_origin"]))
    return tiff.Frame(rows[0]["endian"], made)


def assemble(directories: DataFrame) -> DataFrame:
    """(path, content): files from directory rows; a group is one frame."""

    def kernel(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"path": pa.array([rows[0]["path"]], pa.string()), "content": pa.array([tiff.serialise(frame_of(rows))], pa.binary())})

    return directories.where("error_code is null").groupBy("path").applyInArrow(kernel, "path string, content binary")
