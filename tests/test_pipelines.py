import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rawloom import cli
from rawloom.functions import codec, columns, tiff
from rawloom.functions.errors import FrameError
from rawloom.operators import compare, imaging, residuals
from rawloom.plans import pipelines, queries
from rawloom.session import ship
from rawloom.sources import coverage, frames
from tests import frames_data as made


@pytest.fixture
def clip(tmp_path):
    at = tmp_path / "clip"
    at.mkdir()
    for k, frame in enumerate((made.gradient(), made.rich("Big"), made.tiled())):
        (at / f"f{k}.{'DNG' if k else 'dng'}").write_bytes(tiff.serialise(frame))
    (at / "notes.txt").write_text("no frame")
    (at / ".hidden.dng").write_bytes(tiff.serialise(made.gradient("Big")))
    os.symlink(at / "f0.dng", at / "link.dng")
    return at


def test_listing(clip, tmp_path):
    names = [os.path.basename(p) for p in frames.list_frames(str(clip))]
    assert names == [".hidden.dng", "f0.dng", "f1.DNG", "f2.DNG"]
    (clip / "a").mkdir()
    (clip / "a" / "b").write_text("x")
    (clip / "a.b").write_text("y")
    assert [r for _, r in frames.walk(str(clip))][:3] == [".hidden.dng", "a/b", "a.b"]
    assert frames.walk(str(clip / "a.b")) == [(str(clip / "a.b"), "a.b")] and frames.resolve(str(clip / "link.dng")) == [str(clip / "link.dng")]
    (tmp_path / "none").mkdir()
    for path, code in ((tmp_path / "none", "NoFrames"), (tmp_path / "missing", "NotFileOrDir")):
        with pytest.raises(FrameError) as e:
            frames.resolve(str(path))
        assert e.value.code == code


def test_compress_and_back(spark, clip, tmp_path):
    packed, back = str(tmp_path / "packed"), str(tmp_path / "back")
    stats = pipelines.compress(spark, str(clip), packed).collect()
    assert [os.path.basename(r["input"]) for r in stats] == [".hidden.dng", "f0.dng", "f1.DNG", "f2.DNG"]
    assert all(r["output_bytes"] == os.path.getsize(r["output"]) and r["ratio"] == r["output_bytes"] / r["input_bytes"] for r in stats)
    assert pipelines.decompress(spark, packed, back).count() == 4
    for r in stats:
        name = os.path.basename(r["input"])
        with open(r["input"], "rb") as a, open(os.path.join(back, name), "rb") as b:
            data = a.read()
            assert data == b.read()
        pipelines.verify_roundtrip(data)
        assert pipelines.idempotent(data)
    with pytest.raises(FrameError) as e:
        pipelines.compress(spark, packed, str(tmp_path / "again"), pipelines.CompressOptions(verify=False))
    assert e.value.code == "NothingToCompress"
    with pytest.raises(FrameError) as e:
        pipelines.compress(spark, str(clip), str(clip))
    assert e.value.code == "InPlace"
    assert not [f for f in os.listdir(packed) if f.endswith(".part")]


def test_first_error_is_raised(spark, clip, tmp_path):
    (clip / "f0.dng").write_bytes(b"garbage")
    with pytest.raises(FrameError) as e:
        pipelines.compress(spark, str(clip), str(tmp_path / "out"))
    assert e.value.code == "BadByteOrder"


def test_offload(spark, tmp_path):
    source = tmp_path / "card"
    (source / "sub").mkdir(parents=True)
    (source / "a.dng").write_bytes(b"0123456789abcdef")
    (source / "sub" / "b.dng").write_bytes(b"fedcba9876543210")
    to = [str(tmp_path / "d1"), str(tmp_path / "d2")]
    copies = pipelines.offload(spark, str(source), to)
    total = pipelines.offload_report(copies).first()
    assert (total["files"], total["verified"], total["failed"], total["total_bytes"], total["all_verified"]) == (2, 2, 0, 32, True)
    assert (tmp_path / "d2" / "sub" / "b.dng").read_bytes() == b"fedcba9876543210" and copies.count() == 4
    (tmp_path / "blocked").write_text("a file, no folder")
    bad = pipelines.offload(spark, str(source), [to[0], str(tmp_path / "blocked")])
    total = pipelines.offload_report(bad).first()
    assert (total["verified"], total["failed"], total["all_verified"]) == (0, 2, False)
    with pytest.raises(FrameError) as e:
        pipelines.offload(spark, str(source), [])
    assert e.value.code == "NoDestinations"
    assert compare.offload_totals(compare.file_outcomes(copies.limit(0))).first()["all_verified"] is True


def test_tables(spark, clip):
    contents = frames.read_contents(frames.manifest(spark, frames.walk(str(clip))))
    assert contents.where("error is not null").count() == 0
    rows = frames.parse(contents).cache()
    assert {r["path"].rsplit("/", 1)[1] for r in frames.errors(rows).collect()} == {"notes.txt"}
    rich = [r for r in frames.ifds(rows).collect() if r["path"].endswith("f1.DNG")]
    assert [(r["parent_id"], r["edge"], r["ordinal"], r["pointer_tag"]) for r in sorted(rich, key=lambda r: r["ifd_id"])] == [(-1, "top", 0, None), (0, "sub", 0, None), (0, "pointer", 0, 34665), (2, "pointer", 2, 40965), (0, "pointer", 1, 34853), (-1, "top", 1, None)]
    assert frames.segments(rows).where("path like '%f2.DNG'").count() == 4
    again = {r["path"]: bytes(r["content"]) for r in frames.assemble(rows).collect()}
    for r in contents.collect():
        if not r["path"].endswith(".txt"):
            assert again[r["path"]] == bytes(r["content"])
    packed = pipelines.map_contents(contents.where("path not like '%.txt'"), codec.compress_bytes)
    # The maker note's own offsets move with it; all other tags are the same.
    diff = compare.tag_diff(frames.entries(rows), frames.entries(frames.parse(packed)), ["path", "ifd_id"]).collect()
    assert [(r["tag"], r["kind"]) for r in diff] == [(37500, "Changed")]
    assert compare.tag_diff(frames.entries(rows), frames.entries(frames.parse(packed)), ["path", "ifd_id"], allowed=()).count() > 0
    assert compare.tree_diff(frames.ifds(rows), frames.ifds(frames.parse(packed))).count() == 0
    assert compare.foreign_markers(frames.entries(frames.parse(packed))).count() == 0
    facts = {r["path"].rsplit("/", 1)[1]: r for r in pipelines.inspect_frames(contents).collect()}
    assert facts["notes.txt"]["format"] == "Unknown" and facts["f1.DNG"]["format"] == "DNG" and len(facts["f2.DNG"]["checksum"]) == 64
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in pipelines.renditions(contents).collect()}
    assert kinds["f1.DNG"] == "preview" and kinds["f0.dng"] is None and kinds["notes.txt"] == "BadByteOrder"


def test_missing_file_has_an_error(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "gone"), "gone", None)], frames.MANIFEST)
    assert frames.read_contents(files).first()["error"].startswith("i/o error")


def test_cli(spark, clip, tmp_path, capsys):
    assert cli.main(["compress", str(clip / "f0.dng"), "--out", str(tmp_path / "c")]) == 0
    assert cli.main(["decompress", str(tmp_path / "c"), "--out", str(tmp_path / "d")]) == 0
    assert (tmp_path / "d" / "f0.dng").read_bytes() == (clip / "f0.dng").read_bytes()
    assert cli.main(["offload", str(clip), "--to", str(tmp_path / "o1"), "--to", str(tmp_path / "o2")]) == 0
    assert cli.main(["decompress", str(clip), "--out", str(tmp_path / "x")]) == 1
    out = capsys.readouterr()
    assert "1 frame(s)" in out.out and "verified, 0 failed" in out.out and "no image that this library compressed" in out.err


def test_formatters(spark):
    rows = spark.createDataFrame([(0.0,), (999.0,), (1000.0,), (1536.0,), (12.4e6,), (4.2e9,), (250e9,), (-1.0,), (float("nan"),)], "n double")
    assert [r[0] for r in rows.select(columns.si_bytes("n")).collect()] == ["0 B", "999 B", "1.00 kB", "1.54 kB", "12.4 MB", "4.20 GB", "250 GB", "-", "-"]
    one = spark.range(1)
    shown = one.select(columns.human_bytes(F.lit(1280)), columns.human_bytes(F.lit(512)), columns.human_bytes(F.lit(3 << 30)), columns.format_count(F.lit(6000)), columns.dimensions(F.lit(6000), F.lit(4000)), columns.dimensions(F.lit(None).cast("int"), F.lit(1)), columns.saved_percent(F.lit(0.45)), columns.saved_percent(F.lit(-0.1)), columns.short_hex(F.lit("0123456789" * 4), 10)).first()
    assert list(shown) == ["1.2 KiB", "512 B", "3.0 GiB", "6,000", "6,000 × 4,000 px", "-", "−45.0%", "+10.0%", "0123456789…0123456789"]


def test_si_bytes_rounds_doubles_as_the_sql_does(spark, tmp_path):
    """Keys of a part table 60 times that of sf0.1 whose decimal form is a tie and whose double lies below it."""
    import duckdb

    keys = [4, 30100, 387172, 475428, 498752, 832500, 1129392, 1200000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = dict(con.execute(queries.ORACLES["si_bytes"]).fetchall())
    assert dict(map(tuple, queries.QUERIES["si_bytes"](spark, str(tmp_path)).collect())) == want
    assert want[30100] == "9.65 kB" and want[498752] == "1.25 MB"


def test_sql_functions(spark):
    names = columns.register(spark)
    assert "raw_blake3" in names
    row = spark.sql("select raw_blake3(cast('' as binary)) h, raw_unpack(unhex('102103'), 12, 'Big', 2) s, raw_inspect(cast('x' as binary)).width w, hex(raw_pack(array(258, 259), 12, 'Big')) p").first()
    assert row["h"].startswith("af1349b9") and row["s"] == [0x102, 0x103] and row["w"] is None and row["p"] == "102103"


def test_residuals_equal_the_kernel(spark):
    from rawloom.functions import ljpeg

    rng = np.random.default_rng(9)
    levels = rng.integers(0, 1 << 16, (6, 7)).astype(np.uint16)
    cells = spark.createDataFrame([(y, x, int(levels[y, x])) for y in range(6) for x in range(7)], "y int, x int, s long")
    found = residuals.residuals(cells, 16)
    want = ljpeg.residuals(levels[:, :, None], 16)[:, :, 0]
    got = {(r["y"], r["x"]): (r["d"], r["cat"]) for r in found.collect()}
    assert all(got[y, x] == (want[y, x], ljpeg.categories(want[y, x : x + 1])[0]) for y in range(6) for x in range(7))
    back = {(r["y"], r["x"]): r["s"] for r in residuals.reconstructed(found.select("y", "x", "d"), 16).collect()}
    assert all(back[y, x] == levels[y, x] for y in range(6) for x in range(7))


def test_camera_table(spark):
    found = coverage.cameras(spark).collect()
    assert [r["rank"] for r in found] == list(range(1, 21)) and [r["camera"] for r in found if r["status"] == "Tested"] == ["SIGMA fp"]


def test_demosaic_equals_the_kernel(spark):
    from rawloom.functions import develop

    levels = np.random.default_rng(3).integers(0, 4096, (5, 6))
    cells = spark.createDataFrame([(y, x, int(levels[y, x])) for y in range(5) for x in range(6)], "y long, x long, s long")
    want = develop.demosaic(levels.astype(np.float32), columns.RGGB)
    for r in imaging.demosaic(cells).collect():
        assert np.allclose([r["r"], r["g"], r["b"]], want[r["y"], r["x"]], rtol=1e-5)


def test_sql_functions(spark):
    """Parse, compress, preview and develop from SQL; what is no frame gives null or no row."""
    ship(spark)
    columns.register(spark)
    content = queries.frame_bytes(list(range(64)), width=16)
    spark.createDataFrame([(0, content), (1, b"nothing"), (2, None)], "k int, content binary").createOrReplaceTempView("some_files")
    made = spark.sql("select k, raw_decompress(raw_compress(content)) = content as same, raw_preview(content).width as w, raw_develop(content) as d from some_files order by k").collect()
    assert [(r["same"], r["w"]) for r in made] == [(True, 4), (None, None), (None, None)]
    assert (made[0]["d"]["width"], made[0]["d"]["height"], len(made[0]["d"]["image"])) == (16, 4, 256) and made[1]["d"]["image"] is None
    tags = spark.sql("select k, ifd_id, tag from some_files, lateral raw_parse(content)").collect()
    assert {(r["k"], r["ifd_id"]) for r in tags} == {(0, 0), (0, 1)} and (0, 1, 50717) in {tuple(r) for r in tags}


def test_segments_are_coded_by_themselves(spark):
    """The same bytes and errors as file by file, forwards and back; segments equal on both sides of the way."""
    files = {"a.dng": tiff.serialise(made.gradient()), "b.dng": tiff.serialise(made.rich("Big")), "c.dng": tiff.serialise(made.tiled()), "d.dng": b"nothing", "e.dng": queries.frame_bytes(list(range(64)), width=4)}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    whole = {r["path"]: r for r in pipelines.map_contents(df, lambda b: codec.compress_bytes(b)).collect()}
    packed = pipelines.code_segments(df).collect()
    assert {r["path"]: (r["content"], r["error_code"]) for r in packed} == {p: (r["content"], r["error_code"]) for p, r in whole.items()}
    kept = spark.createDataFrame([(r["path"], r["content"]) for r in packed if r["content"]], "path string, content binary")
    back = pipelines.code_segments(kept, forward=False)
    assert {r["path"]: r["content"] for r in back.collect()} == {r["path"]: codec.decompress_bytes(r["content"]) for r in kept.collect()}
    assert [r["error_code"] for r in pipelines.code_segments(kept).collect()] == ["NothingToCompress"] * kept.count()
    before = frames.segments(frames.parse(df.where("path <> 'd.dng'")))
    assert pipelines.verify_segments(before, frames.segments(frames.parse(back.select("path", "content")))).count() == 0
    assert pipelines.verify_segments(before, before.where("seg_index > 0")).count() == before.where("seg_index = 0").count()
