"""Registered queries over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawloom.functions import codec, columns, samples, tiff
from rawloom.operators import compare, imaging, residuals
from rawloom.plans import pipelines
from rawloom.session import table
from rawloom.sources import frames
from rawloom.sources.coverage import CAMERAS, cameras

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return keep


#: Rows of an image of the sample grid.
ROWS = 64
#: The sample grid that stands in for frames: y = vec_id, x = position, 12 bits; ROWS vectors are an image.
GRID_SQL = """select vec_id // 64 image, vec_id y, x - 1 x, cast(floor((cast(embedding[x] as double) + 1.0) * 2047.0) as bigint) & 4095 s
from embeddings, generate_series(1, len(embedding)) g(x)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / ROWS).alias("image"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    level = F.floor((F.col("e").cast("double") + 1.0) * 2047.0).cast("bigint").bitwiseAND(F.lit(4095))
    return cells.select("image", "y", "x", level.alias("s"))


RESIDUAL_SQL = f"""with g as ({GRID_SQL}),
n as (select y, x, s, lag(s) over (partition by y order by x) l, lag(s) over (partition by image, x order by y) u from g),
d as (select y, x, ((s - coalesce(l, u, 2048) + 32768) & 65535) - 32768 d from n),
r as (select y, x, d, case when d = 0 then 0 else length(bin(abs(d))) end cat from d)"""


@query(f"{RESIDUAL_SQL} select cat, count(*) n, sum(d) sd from r group by 1")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.histogram(residuals.residuals(grid(spark, sf_dir), 12, ["image"]))


@query(f"{RESIDUAL_SQL} select y, x, d, cat from r")
def residual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.residuals(grid(spark, sf_dir), 12, ["image"]).select("y", "x", "d", "cat")


@query(f"select y, x, s from ({GRID_SQL})")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples again, from nothing but the residuals."""
    found = residuals.residuals(grid(spark, sf_dir), 12, ["image"]).select("image", "y", "x", "d")
    return residuals.reconstructed(found, 12, ["image"]).select("y", "x", "s")


@query(f"""{RESIDUAL_SQL} select cat, cast(sum(case when d >= 0 then d else d + (1 << cat) - 1 end) as bigint) bits_sum,
max(case when d >= 0 then d else d + (1 << cat) - 1 end) bits_max from r group by 1""")
def entropy_value_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residuals.residuals(grid(spark, sf_dir), 12, ["image"])
    return found.groupBy("cat").agg(F.sum("bits").cast("bigint").alias("bits_sum"), F.max("bits").alias("bits_max"))


#: Code lengths of a table: (symbol, length).
LENGTHS = ((0, 3), (1, 3), (2, 3), (3, 3), (4, 3), (5, 4), (6, 4), (7, 5), (8, 5), (9, 6), (10, 6), (11, 7), (12, 8))
LENGTHS_SQL = "(values " + ", ".join(map(str, LENGTHS)) + ") t(symbol, len)"


def lengths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LENGTHS), "symbol int, len int")


CODES_SQL = f"""select symbol, len, cast(coalesce(sum(1 << (16 - len)) over (order by len, symbol rows between unbounded preceding and 1 preceding), 0) // (1 << (16 - len)) as bigint) code
from {LENGTHS_SQL}"""


@query(CODES_SQL)
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.canonical_codes(lengths(spark)).select("symbol", "len", "code")


@query(f"""{RESIDUAL_SQL}, h as (select cat, count(*) n from r group by 1)
select cast(sum(n * (len + case when cat < 16 then cat else 0 end)) as bigint) bits from h join {LENGTHS_SQL} on cat = symbol""")
def coded_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the coded grid under the literal table."""
    return residuals.coded_bits(residual_histogram(spark, sf_dir), lengths(spark))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: name, size in bytes, and another size that stands for the compressed one."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", "text", size.alias("input_bytes"), (size - F.floor(size * (F.col("doc_id") % 7) / 10)).cast("bigint").alias("output_bytes"))


FILES_SQL = """files as (select doc_id, source, text, i input_bytes, cast(i - floor(i * (doc_id % 7) / 10) as bigint) output_bytes
from (select *, coalesce(octet_length(encode(text)), 0) i from documents))"""


@query(f"""with {FILES_SQL} select count(*) frames, cast(sum(input_bytes) as bigint) input_bytes, cast(sum(output_bytes) as bigint) output_bytes,
round(sum(output_bytes) / sum(input_bytes), 9) ratio from files""")
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summary(files(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query(f"""with {FILES_SQL} select doc_id, round(case when input_bytes = 0 then 0 else output_bytes / input_bytes end, 9) ratio,
round(case when input_bytes = 0 then 0 else 1 - output_bytes / input_bytes end, 9) saved from files""")
def frame_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("output_bytes"), F.col("input_bytes")
    return files(spark, sf_dir).select("doc_id", F.round(columns.ratio(a, b), 9).alias("ratio"), F.round(columns.saved(a, b), 9).alias("saved"))


TAGS_SQL = """tags as (select user_id path, cast(event_id % 37 + 240 as bigint) tag, max(event_type) v from events group by 1, 2),
a as (select path, tag, v from tags where tag % 11 <> 3),
b as (select path, case when tag % 10 = 7 then tag + 1000 else tag end tag, case when tag % 5 = 0 then v || 'x' else v end v from tags where tag % 13 <> 5)"""


def tag_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a tag table that stands for events: some tags removed, some added, some changed."""
    tags = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path"), (F.col("event_id") % 37 + 240).alias("tag")).agg(F.max("event_type").alias("v"))
    value = F.when(F.col("tag") % 5 == 0, F.concat("v", F.lit("x"))).otherwise(F.col("v"))
    tag = F.when(F.col("tag") % 10 == 7, F.col("tag") + 1000).otherwise(F.col("tag"))
    return tags.where("tag % 11 <> 3"), tags.where("tag % 13 <> 5").select("path", tag.alias("tag"), value.alias("v"))


@query(f"""with {TAGS_SQL} select * from (select coalesce(a.path, b.path) path, coalesce(a.tag, b.tag) tag,
case when a.path is null then 'Added' when b.path is null then 'Removed' when a.v is distinct from b.v then 'Changed' end kind
from a full outer join b on a.path = b.path and a.tag = b.tag) where kind is not null and tag not in (259, 41449)""")
def tag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tag_tables(spark, sf_dir)
    return compare.tag_diff(a, b, ["path"], "v")


@query(f"""with {TAGS_SQL}, c as (select path, tag, v || '!' v from a where tag % 4 = 0)
select a.path, a.tag, coalesce(c.v, a.v) v from a left join c on a.path = c.path and a.tag = c.tag where a.tag <> 256""")
def tag_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace the values of some tags, remove one."""
    a, _ = tag_tables(spark, sf_dir)
    changes = a.where("tag % 4 = 0").withColumn("v", F.concat("v", F.lit("!")))
    return compare.upsert(a, changes, ["path", "tag"]).where("tag <> 256").select("path", "tag", "v")


@query("""with n as (select user_id path, cast(event_id % 3 as int) parent_id, case when event_id % 2 = 0 then 'sub' else 'pointer' end edge, cast(event_id % 5 as int) ordinal, max(event_id % 4) p from events group by all),
a as (select * from n where ordinal <> 4 or path % 2 = 0), b as (select path, parent_id, edge, ordinal, case when path % 9 = 0 then p + 1 else p end p from n where ordinal <> 2 or path % 3 = 0)
select * from (select coalesce(a.path, b.path) path, coalesce(a.parent_id, b.parent_id) parent_id, coalesce(a.edge, b.edge) edge, coalesce(a.ordinal, b.ordinal) ordinal,
case when a.path is null then 'Added' when b.path is null then 'Removed' when a.p is distinct from b.p then 'Changed' end kind
from a full outer join b on a.path = b.path and a.parent_id = b.parent_id and a.edge = b.edge and a.ordinal = b.ordinal) where kind is not null""")
def tree_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    keys = [F.col("user_id").alias("path"), (e % 3).cast("int").alias("parent_id"), F.when(e % 2 == 0, "sub").otherwise("pointer").alias("edge"), (e % 5).cast("int").alias("ordinal")]
    nodes = table(spark, sf_dir, "events").groupBy(*keys).agg(F.max(e % 4).alias("pointer_tag"))
    other = F.when(F.col("path") % 9 == 0, F.col("pointer_tag") + 1).otherwise(F.col("pointer_tag"))
    return compare.tree_diff(nodes.where("ordinal <> 4 or path % 2 = 0"), nodes.where("ordinal <> 2 or path % 3 = 0").withColumn("pointer_tag", other))


@query("""select event_id, tag from (select event_id, cast(case when event_id % 3 = 0 then 41449 else 256 + event_id % 5 end as bigint) tag,
case when event_id % 2 = 0 then 4 else 3 end type_code, case when event_id % 5 = 0 then 42 else 1095520328 end v from events)
where tag = 41449 and not (type_code = 4 and v = 1095520328)""")
def marker_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e, F.when(e % 3 == 0, F.lit(41449).cast("bigint")).otherwise(256 + e % 5).alias("tag"), F.when(e % 2 == 0, 4).otherwise(3).alias("type_code"),
        F.array(F.when(e % 5 == 0, F.lit(42)).otherwise(F.lit(1095520328)).cast("bigint")).alias("ints"),
    )
    return compare.foreign_markers(rows).select("event_id", "tag")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents copied to two destinations, some of them damaged or unreadable."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    found = docs.select(F.col("doc_id").alias("source"), F.octet_length("text").cast("bigint").alias("size"), "text", F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("destination"))
    damaged = (F.col("source") % 17 == 0) & (F.col("destination") == "d2")
    again = F.when(damaged, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    status = F.when(F.sha2("text", 256) == F.sha2(again, 256), "Verified").otherwise("ChecksumMismatch")
    return found.select("source", "size", "destination", status.alias("status"), F.when(F.col("source") % 101 == 5, "unreadable").alias("error"))


COPIES_SQL = """copies as (select doc_id source, octet_length(encode(text)) size, d destination,
case when sha256(text) = sha256(case when doc_id % 17 = 0 and d = 'd2' then text || '?' else text end) then 'Verified' else 'ChecksumMismatch' end status,
case when doc_id % 101 = 5 then 'unreadable' end error from documents, (values ('d1'), ('d2')) t(d) where text is not null),
outcomes as (select source, max(size) size, max(error) error, count(destination) destinations, count(*) filter (status = 'Verified') verified from copies group by 1),
judged as (select *, error is null and destinations > 0 and destinations = verified ok from outcomes)"""


@query(f"with {COPIES_SQL} select * from judged")
def offload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.file_outcomes(copies(spark, sf_dir))


@query(f"""with {COPIES_SQL} select count(*) files, count(*) filter (ok) verified, count(*) - count(*) filter (ok) failed,
cast(sum(size) as bigint) total_bytes, coalesce(bool_and(ok), true) all_verified from judged""")
def offload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.offload_totals(compare.file_outcomes(copies(spark, sf_dir)))


@query("select doc_id, sha256(text) checksum from documents")
def checksum_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query()
def checksum_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE3 of every document; SQL has no such function, the tests hold it against published vectors."""
    columns.register(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.call_function("raw_blake3", F.col("text").cast("binary")).alias("checksum"))


#: Published BLAKE3 test vectors: the hashes of as many bytes, which count up modulo 251.
BLAKE3_VECTORS = ((0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"), (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"), (2049, "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"), (31744, "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"), (102400, "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"))


@query("select n, checksum from (values " + ", ".join(map(str, BLAKE3_VECTORS)) + ") t(n, checksum)")
def blake3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published vectors, from their inputs."""
    columns.register(spark)
    sizes = spark.createDataFrame([(n,) for n, _ in BLAKE3_VECTORS], "n int")
    step = F.unhex(F.lit(bytes(range(251)).hex()))
    filled = F.aggregate(F.sequence(F.lit(0), F.floor(F.col("n") / 251).cast("int")), F.lit(b""), lambda a, _: F.concat(a, step))
    return sizes.select("n", F.call_function("raw_blake3", F.substring(filled, F.lit(1), F.col("n"))).alias("checksum"))


@query("""select label, vec_id, area from (select label, vec_id, a area, row_number() over (partition by label order by a desc, vec_id) r
from (select *, cast(floor(abs(embedding[1]) * 40) * floor(abs(embedding[2]) * 40) as bigint) a from embeddings) where a > 0) where r = 1""")
def largest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: F.floor(F.abs(F.get("embedding", F.lit(k))) * F.lit(40.0).cast("float"))
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (side(0) * side(1)).cast("bigint").alias("area"))
    return compare.top_one(rows, ["label"], F.col("area"), "vec_id").select("label", "vec_id", "area")


@query(f"""with g as (select image, y, x, s, case when y % 2 = 0 and x % 2 = 0 then 0 when y % 2 = 1 and x % 2 = 1 then 2 else 1 end c from ({GRID_SQL})),
o as (select dy, dx from range(-1, 2) a(dy), range(-1, 2) b(dx))
select p.y, p.x, round(coalesce(avg(q.s) filter (q.c = 0), 0), 6) r, round(coalesce(avg(q.s) filter (q.c = 1), 0), 6) g, round(coalesce(avg(q.s) filter (q.c = 2), 0), 6) b
from (select image, g.y, g.x, g.y + dy ny, g.x + dx nx from g, o) p join g q on q.image = p.image and q.y = p.ny and q.x = p.nx group by 1, 2""")
def demosaic_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = imaging.demosaic(grid(spark, sf_dir), ["image"])
    return made.select("y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


@query(f"""select y, x, round(greatest(0, least(1, (s - (128 + 16 * (y % 2 * 2 + x % 2))) / greatest(3800.0 - (128 + 16 * (y % 2 * 2 + x % 2)), 1.0))), 9) v from ({GRID_SQL})""")
def normalise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("y") % 2 * 2 + F.col("x") % 2
    return grid(spark, sf_dir).select("y", "x", F.round(columns.normalised("s", 128 + 16 * place, F.lit(3800)), 9).alias("v"))


def _transfer_sql(g: str) -> str:
    return f"""select event_id, cast(least(255, greatest(0, floor(({g}) * 255.0 + 0.5))) as int) level
from (select event_id, greatest(0.0, least(1.0, cast(value as double) / 100.0)) c from events)"""


@query(_transfer_sql("case when c <= 0.0031308 then 12.92 * c else 1.055 * pow(c, 1.0 / 2.4) - 0.055 end"))
def transfer_srgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", columns.transfer(F.col("value") / 100.0).alias("level"))


@query(_transfer_sql("case when c < 0.018 then 4.5 * c else 1.099 * pow(c, 0.45) - 0.099 end"))
def transfer_rec709(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", columns.transfer(F.col("value") / 100.0, "rec709").alias("level"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"m{k}") for k in range(12)])


_M = ", ".join(f"cast(embedding[{k + 1}] as double) m{k}" for k in range(12))
_XYZ = [x for row in columns.XYZ_TO_SRGB for x in row]


@query("select vec_id, " + ", ".join(f"round(({_XYZ[3 * i]}::double) * m0 + ({_XYZ[3 * i + 1]}::double) * m1 + ({_XYZ[3 * i + 2]}::double) * m2, 6) v{i}" for i in range(3)) + f" from (select vec_id, {_M} from embeddings)")
def colour_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.apply3([F.lit(x) for x in _XYZ], [F.col(f"m{k}") for k in range(3)])
    return matrix(spark, sf_dir).select("vec_id", *[F.round(v, 6).alias(f"v{i}") for i, v in enumerate(found)])


#: The entries of the adjugate of m0 to m8.
_ADJUGATE = ("m4 * m8 - m5 * m7", "m2 * m7 - m1 * m8", "m1 * m5 - m2 * m4", "m5 * m6 - m3 * m8", "m0 * m8 - m2 * m6", "m2 * m3 - m0 * m5", "m3 * m7 - m4 * m6", "m1 * m6 - m0 * m7", "m0 * m4 - m1 * m3")


@query("select vec_id, round(det, 6) det, " + ", ".join(f"case when abs(det) >= 1e-9 then cast(round(det * (({a}) / det), 6) as double) end a{k}" for k, a in enumerate(_ADJUGATE)) + f"""
from (select *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) det from (select vec_id, {_M} from embeddings))""")
def invert_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinants and the inverses, times the determinant so that rounding is even."""
    det, inverse = columns.invert3([F.col(f"m{k}") for k in range(9)])
    return matrix(spark, sf_dir).select("vec_id", F.round(det, 6).alias("det"), *[F.round(det * x, 6).alias(f"a{k}") for k, x in enumerate(inverse)])


@query("select vec_id, " + ", ".join(f"round(({_XYZ[3 * i]}::double) * m{j} + ({_XYZ[3 * i + 1]}::double) * m{3 + j} + ({_XYZ[3 * i + 2]}::double) * m{6 + j}, 6) p{3 * i + j}" for i in range(3) for j in range(3)) + f" from (select vec_id, {_M} from embeddings)")
def matmul_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = columns.matmul3([F.lit(x) for x in _XYZ], [F.col(f"m{k}") for k in range(9)])
    return matrix(spark, sf_dir).select("vec_id", *[F.round(v, 6).alias(f"p{k}") for k, v in enumerate(made)])


@query("select vec_id, case when vec_id % 3 = 0 then vec_id when vec_id % 3 = 1 then -vec_id end first, case when vec_id % 3 < 2 then 9 end n from embeddings")
def colour_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second matrix where it has nine numbers, else the first, else none."""
    k = F.col("vec_id")
    nine, few = lambda v: F.array_repeat(v, 9), lambda v: F.array_repeat(v, 8)
    second = F.when(k % 3 == 0, nine(k)).otherwise(few(k))
    first = F.when(k % 3 == 1, nine(-k)).when(k % 3 == 0, nine(k + 1)).otherwise(few(k))
    found = columns.colour_matrix(second, first)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(found, F.lit(8)).alias("first"), F.when(found.isNotNull(), F.size(found)).alias("n"))


@query("""select p_partkey, cast(strip as int) strip, strip * rps first_row, least(rps, height - strip * rps) rows_in
from (select p_partkey, p_size * 37 height, cast(p_partkey % 11 + 1 as bigint) rps, unnest(range(0, greatest(cast(ceil(p_size * 37 / (p_partkey % 11 + 1)) as bigint), 1))) strip from part) where strip * rps < height""")
def strip_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).cast("bigint").alias("height"), (F.col("p_partkey") % 11 + 1).alias("rows_per_strip"))
    return imaging.strips(images).select("p_partkey", "strip", "first_row", F.col("rows").alias("rows_in"))


@query("""select l_orderkey, l_linenumber, n, cast(8 + coalesce(sum(n + n % 2) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as bigint) "offset"
from (select l_orderkey, l_linenumber, cast(sum(l_quantity) as bigint) n from lineitem group by 1, 2)""")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("n"))
    return imaging.running_offsets(pieces, ["l_orderkey"], ["l_linenumber"], "n").select("l_orderkey", "l_linenumber", "n", "offset")


@query("""select l_orderkey, string_agg(chr(cast(65 + n % 26 as int)), '' order by l_linenumber) joined
from (select l_orderkey, l_linenumber, cast(sum(l_quantity) as bigint) n from lineitem group by 1, 2) group by 1""")
def joined_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each order, one byte each, in order."""
    pieces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("seg_index")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    bytes_of = pieces.select("l_orderkey", "seg_index", F.chr(65 + F.col("n") % 26).cast("binary").alias("bytes"))
    return imaging.joined_segments(bytes_of, ["l_orderkey"]).select("l_orderkey", F.col("bytes").cast("string").alias("joined"))


@query("select p_partkey, cast(p_partkey * 7 % 4096 as int) a, cast(p_size * 81 % 4096 as int) b, printf('%03X', p_partkey * 7 % 4096) || printf('%03X', p_size * 81 % 4096) packed from part")
def pack12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 12-bit samples in three bytes, and the samples read back from them."""
    a, b = F.col("p_partkey") * 7 % 4096, F.col("p_size") * 81 % 4096
    packed = table(spark, sf_dir, "part").select("p_partkey", columns.pack12(a, b).alias("packed"))
    first, second = columns.unpack12(F.unhex("packed"), F.lit(0))
    return packed.select("p_partkey", first.cast("int").alias("a"), second.cast("int").alias("b"), "packed")


@query("select p_partkey, substr(h, 3, 2) || substr(h, 1, 2) swapped, substr(h, 3, 2) || substr(h, 1, 2) || '000000000000' long_swapped, printf('%02X', (p_partkey * 31) % 256) || printf('%02X', (p_partkey * 31) // 256 % 256) little from (select p_partkey, printf('%04X', p_partkey * 31 % 65536) h from part)")
def endian_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.unhex(F.lpad(F.hex(F.col("p_partkey") * 31 % 65536), 4, "0"))
    swapped = F.hex(columns.swap16(big))
    return table(spark, sf_dir, "part").select("p_partkey", swapped.alias("swapped"), F.hex(columns.swap64(F.concat(F.unhex(F.lit("000000000000")), big))).alias("long_swapped"), F.hex(F.substring(columns.swap32(F.concat(F.unhex(F.lit("0000")), big)), 1, 2)).alias("little"))


GUARD_ROWS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) q from lineitem"""


@query(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, q, case when q % 13 = 0 then 'skip' when q % 11 = 5 then 'skip' when q % 7 = 3 then 'UnsupportedPlanarConfig'
when l_partkey % 17 = 0 then 'MissingTag' when l_partkey % 5 = 1 then 'InconsistentBitDepth' when l_partkey % 3 = 2 then 'UnsupportedBitDepth'
when l_suppkey % 4 = 3 then 'InconsistentBitDepth' when l_orderkey % 19 = 0 then 'MissingTag' when l_orderkey % 23 = 0 then 'DimensionTooLarge' end code from ({GUARD_ROWS})""")
def guard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered checks before an image is compressed, over made-up tags."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("bigint").alias("q"))
    bits = F.when(c("l_partkey") % 17 != 0, F.array(F.when(c("l_partkey") % 3 == 2, 11).otherwise(12), F.when(c("l_partkey") % 5 == 1, 9).when(c("l_partkey") % 3 == 2, 11).otherwise(12)))
    code = columns.guard(
        c("q") % 13 != 0, F.when(c("q") % 11 == 5, 7).when(c("q") % 11 == 6, 1), F.when(c("q") % 7 == 3, 2), bits,
        F.when(c("l_suppkey") % 4 == 3, 3).otherwise(2), F.when(c("l_orderkey") % 19 != 0, 640), F.when(c("l_orderkey") % 23 == 0, 70000).otherwise(480),
    )
    return rows.withColumn("code", code)


@query(f"""with {FILES_SQL}, v as (select doc_id, input_bytes * (1 + doc_id % 5 * 1000) n from files)
select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KiB', round_even(n / 1024.0, 1)) when n < 1073741824 then printf('%.1f MiB', round_even(n / 1048576.0, 1)) else printf('%.1f GiB', round_even(n / 1073741824.0, 1)) end shown from v""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("input_bytes") * (1 + F.col("doc_id") % 5 * 1000)
    return files(spark, sf_dir).select("doc_id", columns.human_bytes(n).alias("shown"))


@query("""select k, case when n < 1000 then n || ' B' when v < 10 then printf('%.2f', floor(v * 100 + 0.5) / 100) || unit when v < 100 then printf('%.1f', floor(v * 10 + 0.5) / 10) || unit else printf('%.0f', floor(v + 0.5)) || unit end shown
from (select *, cast(n as double) / pow(1000, e) v, [' B', ' kB', ' MB', ' GB', ' TB', ' PB'][e + 1] unit from (select *, case when n < 1000 then 0 when n < 1000000 then 1 when n < 1000000000 then 2 when n < 1000000000000 then 3 when n < 1000000000000000 then 4 else 5 end e
from (select p_partkey k, cast(p_partkey * 997 % 2000003 as bigint) * [1, 1009, 1000003, 1000000007][p_partkey % 4 + 1] n from part)))""")
def si_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from bytes to petabytes."""
    k = F.col("p_partkey")
    n = k * 997 % 2000003 * F.get(F.array(*[F.lit(x).cast("bigint") for x in (1, 1009, 1000003, 1000000007)]), (k % 4).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("k"), columns.si_bytes(n).alias("shown"))


@query("select doc_id, left(sha256(text), 10) || '…' || right(sha256(text), 10) short, format('{:,}', n_chars) shown from documents")
def short_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", columns.short_hex(F.sha2("text", 256), 10).alias("short"), columns.format_count("n_chars").alias("shown"))


NAMES_SQL = "names as (select page_id, case when page_id % 3 = 0 then url || '.DNG' when page_id % 3 = 1 then url || '.tif' else url || '.dng' end name, page_id % 4 <> 1 is_tiff from pages)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as file names."""
    end = F.when(F.col("page_id") % 3 == 0, ".DNG").when(F.col("page_id") % 3 == 1, ".tif").otherwise(".dng")
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("name"), (F.col("page_id") % 4 != 1).alias("is_tiff"))


@query(f"with {NAMES_SQL} select page_id, case when not is_tiff then 'Unknown' when lower(name) like '%.dng' then 'DNG' else 'TIFF' end format, regexp_replace(name, '\\.dng$', '', 'i') || '.packed.dng' download from names")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("page_id", columns.detect_format("name", F.col("is_tiff")).alias("format"), columns.download_name("name").alias("download"))


@query(f"with {NAMES_SQL} select page_id, name from names where lower(name) like '%_.dng' and lower(name) not like '%/.dng'")
def frame_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).where(columns.is_frame_name("name")).select("page_id", "name")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 4 = 0 then 0.0 else round(l_partkey / (l_linenumber % 4), 6) end v from lineitem""")
def rational_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.struct(F.col("l_partkey").alias("n"), (F.col("l_linenumber") % 4).cast("bigint").alias("d")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.get(columns.rational_numbers(pair), F.lit(0)), 6).alias("v"))


@query("""select p_partkey, case p_size % 4 when 0 then 0 when 1 then p_partkey when 2 then p_partkey + 1 else p_partkey + 1 end b1,
case p_size % 4 when 0 then 0 when 1 then p_partkey when 2 then p_partkey else p_partkey + 2 end b2,
case when p_size % 4 = 3 and p_partkey % 2 = 0 and p_partkey > 0 then p_partkey else 1 end n0, case when p_size % 5 = 4 then p_size else 0 end c0 from part""")
def develop_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black levels, neutral and colour filter from tags with as many numbers as p_size says."""
    k = F.col("p_partkey")
    level = F.slice(F.array(k, k + 1, k + 2), 1, (F.col("p_size") % 4).cast("int"))
    three = F.transform(level, lambda v: F.when(k % 2 == 0, v).otherwise(0))
    pattern = F.slice(F.array(*[F.col("p_size")] * 4), 1, (F.col("p_size") % 5).cast("int"))
    black, neutral, cfa = columns.black_levels(level), columns.neutral(three), columns.colour_filter(pattern)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(black, F.lit(1)).cast("bigint").alias("b1"), F.get(black, F.lit(2)).cast("bigint").alias("b2"), F.get(neutral, F.lit(0)).cast("bigint").alias("n0"), F.get(cfa, F.lit(0)).alias("c0"))


@query("select p_partkey, case p_partkey % 14 when 1 then 1 when 2 then 1 when 3 then 2 when 4 then 4 when 5 then 8 when 6 then 1 when 7 then 1 when 8 then 2 when 9 then 4 when 10 then 8 when 11 then 4 when 12 then 8 end size, p_partkey % 400 in (273, 278, 279, 322, 323, 324, 325, 330) structural, cast((1 << (p_partkey % 33)) - 1 as bigint) mask, (p_partkey * 5 + p_size) * 3 + p_partkey % 3 place from part")
def tag_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, columns.type_size((k % 14).cast("int")).alias("size"), columns.is_structural(k % 400).alias("structural"),
        columns.mask(k % 33).alias("mask"), columns.sample_index(F.col("p_size"), k, k % 3, F.lit(5), F.lit(3)).alias("place"),
    )


@query("select rank, status, camera, format, sample, tested, total from (values " + ", ".join(str(row) for row in CAMERAS) + ") t(rank, status, camera, format, sample), (select 1 tested, 20 total)")
def camera_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cameras, with how many of how many are tested."""
    found = cameras(spark)
    total = found.agg(F.count_if(F.col("status") == "Tested").cast("int").alias("tested"), F.count("*").cast("int").alias("total"))
    return found.join(F.broadcast(total))


def frame_bytes(levels: list[int], endian: str = "Little", width: int = 8, depth: int = 16) -> bytes:
    """A frame whose raw image, below a thumbnail, has the given samples."""
    make = lambda tag, kind, v: tiff.make(tag, kind, v, endian)
    height = len(levels) // width
    thumb = tiff.Directory(entries=[make(256, 3, [4]), make(257, 3, [2]), make(259, 3, [7]), make(271, 2, b"Maker\0")], layout="Strips", rows_per_strip=2, segments=[b"\xff\xd8" + bytes(levels[0] % 251 for _ in range(6))])
    tags = [make(256, 4, [width]), make(257, 4, [height]), make(258, 3, [depth]), make(259, 3, [1]), make(262, 3, [32803]), make(277, 3, [1]), make(0x9000, 2, b"frame-meta\0"), make(50717, 4, [4095])]
    raw = tiff.Directory(0, "sub", 0, None, tags, "Strips", height, None, None, [samples.pack(np.array(levels, np.uint16), depth, endian) + b"\xab"])
    return tiff.serialise(tiff.Frame(endian, [thumb, raw]))


def level_of(e: Column) -> Column:
    """The 12-bit sample of an element of a vector."""
    return F.floor((e.cast("double") + 1.0) * 2047.0).cast("bigint").bitwiseAND(F.lit(4095)).cast("int")


#: Widths of the frames made of vectors, by vec_id.
WIDTHS = (4, 8, 16)


def frame_files(spark: SparkSession, sf_dir: str, level: Callable[[Column], Column] = level_of) -> DataFrame:
    """(path, content): a frame of every vector of 64 elements, 4, 8 or 16 samples wide."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [frame_bytes(v, ("Little", "Big")[sum(v) % 2], WIDTHS[k % 3]) for k, v in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([f"{k:09d}.dng" for k in ids]), pa.array(made, pa.binary())], names=["path", "content"])

    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.transform("embedding", level).alias("levels"))
    return rows.mapInArrow(kernel, "path string, content binary")


def sample_sum(data: Column, endian: Column, count: int) -> Column:
    """The sum of 16-bit samples."""
    byte = lambda k: F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("bigint")
    high = F.when(endian == "Big", 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0).cast("bigint"), lambda a, k: a + byte(2 * k + 2 - high) * 256 + byte(2 * k + 1 + high))


LEVELS_SQL = f"levels as (select y vec_id, cast(sum(s) as bigint) total, min_by(s, x) first, [4, 8, 16][y % 3 + 1] width from ({GRID_SQL}) group by y having count(*) = 64)"


@query(f"with {LEVELS_SQL} select vec_id, cast(total as bigint) total, 8 width, 8 height, true whole from levels")
def ljpeg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector through the codec and back: the sum of the decoded samples, and whether the stream was used up."""
    columns.register(spark)
    cells = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    made = cells.select("vec_id", F.call_function("ljpeg_encode", F.transform("embedding", level_of), F.lit(8), F.lit(8), F.lit(1), F.lit(12)).alias("stream"))
    back = made.select("vec_id", "stream", F.call_function("ljpeg_decode", "stream").alias("d"))
    total = F.aggregate("d.samples", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return back.select("vec_id", total.alias("total"), "d.width", "d.height", (F.col("d.consumed") == F.octet_length("stream")).alias("whole"))


def _vec() -> Column:
    return F.left("path", F.lit(9)).cast("bigint").alias("vec_id")


@query(f"with {LEVELS_SQL} select vec_id, true same, 2 directories, 12 tags, 129 raw_bytes, total from levels")
def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed into tables and assembled again: the bytes are the same, and the segments hold the samples."""
    found = frame_files(spark, sf_dir)
    rows = frames.parse(found)
    again = frames.assemble(rows).withColumnRenamed("content", "again")
    raw = F.when(F.col("ifd_id") == 1, sample_sum(F.get("segments", F.lit(0)), F.col("endian"), 64))
    stats = rows.groupBy("path").agg(F.count("*").cast("int").alias("directories"), F.sum(F.size("entries")).cast("int").alias("tags"), F.max(F.octet_length(F.get("segments", F.lit(0)))).alias("raw_bytes"), F.max(raw).alias("total"))
    return found.join(again, "path").join(stats, "path").select(_vec(), (F.col("content") == F.col("again")).alias("same"), "directories", "tags", "raw_bytes", "total")


@query(f"with {LEVELS_SQL} select vec_id, true same, true proved, total from levels")
def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames compressed with proof and decompressed again: the bytes are the same, and so are the samples."""
    found = frame_files(spark, sf_dir)
    packed = pipelines.map_contents(found, codec.compress_bytes)
    back = pipelines.map_contents(packed, codec.decompress_bytes).select("path", F.col("content").alias("again"))
    proved = packed.select("path", F.col("error_code").isNull().alias("proved"))
    raw = frames.parse(back.select("path", F.col("again").alias("content"))).where("ifd_id = 1")
    totals = raw.select("path", sample_sum(F.get("segments", F.lit(0)), F.col("endian"), 64).alias("total"))
    return found.join(back, "path").join(proved, "path").join(totals, "path").select(_vec(), (F.col("content") == F.col("again")).alias("same"), "proved", "total")


@query(f"""with cells as (select y vec_id, x // w py, x % w px, case when s >= 2048 then 1.0 else 0.0 end v from (select *, [4, 8, 16][y % 3 + 1] w, count(*) over (partition by y) n from ({GRID_SQL})) where n = 64),
coloured as (select *, case when py % 2 = 0 and px % 2 = 0 then 0 when py % 2 = 1 and px % 2 = 1 then 2 else 1 end c from cells),
means as (select p.vec_id, p.py, p.px, c.k, coalesce(avg(q.v) filter (q.c = c.k), 0) m from cells p, (values (0), (1), (2)) c(k), coloured q
where q.vec_id = p.vec_id and abs(q.py - p.py) <= 1 and abs(q.px - p.px) <= 1 group by all),
shown as (select *, cast(floor((case when m <= 0.0031308 then 12.92 * m else 1.055 * pow(m, 1.0 / 2.4) - 0.055 end) * 255.0 + 0.5) as bigint) level from means)
select vec_id, 'developed' kind, cast([4, 8, 16][vec_id % 3 + 1] as int) width, cast(64 // [4, 8, 16][vec_id % 3 + 1] as int) height, cast(sum(level) filter (k = 0) as bigint) red, cast(sum(level) filter (k = 1) as bigint) green,
cast(sum(level) filter (k = 2) as bigint) blue, cast(sum(level * (py * 31 + px * 7 + k)) as bigint) placed from shown group by 1""")
def develop_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of black and white samples, developed: the sums of each channel, and of all levels weighted by place."""
    made = pipelines.renditions(frame_files(spark, sf_dir, lambda e: F.when(level_of(e) >= 2048, 4095).otherwise(0)))
    byte = lambda k: F.conv(F.hex(F.substring("image", k + 1, F.lit(1))), 16, 10).cast("bigint")
    places, zero = F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint")
    channel = lambda c: F.aggregate(places, zero, lambda a, k: a + byte(4 * k + c))
    weight = lambda k: F.floor(k / F.col("width")) * 31 + k % F.col("width") * 7
    placed = F.aggregate(places, zero, lambda a, k: (a + byte(4 * k) * weight(k) + byte(4 * k + 1) * (weight(k) + 1) + byte(4 * k + 2) * (weight(k) + 2)).cast("bigint"))
    return made.select(_vec(), "kind", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"), placed.alias("placed"))


@query(f"with {LEVELS_SQL} select vec_id, 4 width, 2 height, 8 bytes, cast(first % 251 as int) last from levels")
def preview_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest JPEG of each frame, from the tables of directories and tags, and its last byte."""
    rows = frames.parse(frame_files(spark, sf_dir))
    tag = lambda t: F.get(F.get(F.filter("entries", lambda e: e["tag"] == t), F.lit(0))["ints"], F.lit(0))
    data = F.aggregate("segments", F.lit(b""), lambda a, b: F.concat(a, b))
    images = rows.select("path", "ifd_id", tag(256).alias("width"), tag(257).alias("height"), tag(259).alias("compression"), data.alias("data"))
    images = images.where(F.col("compression").isin(6, 7) & (F.octet_length("data") >= 4) & (F.hex(F.left("data", F.lit(2))) == "FFD8"))
    best = compare.top_one(images, ["path"], F.col("width") * F.col("height"), "ifd_id")
    last = F.conv(F.hex(F.substring("data", -1, 1)), 16, 10).cast("int")
    return best.select(_vec(), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.octet_length("data").alias("bytes"), last.alias("last"))


@query(f"with {LEVELS_SQL} select vec_id, case when total % 2 = 0 then 'little-endian' else 'big-endian' end byte_order, false big_tiff, cast(width as int) width, cast(64 // width as int) height, 8 tag_count, 'DNG' format, true hashed from levels")
def inspect_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns.register(spark)
    files_ = frame_files(spark, sf_dir)
    hashes = files_.select("path", F.call_function("raw_blake3", "content").alias("again"))
    found = pipelines.inspect_frames(files_).join(hashes, "path")
    return found.select(_vec(), "byte_order", "big_tiff", *[F.col(c).cast("int").alias(c) for c in ("width", "height", "tag_count")], "format", (F.col("checksum") == F.col("again")).alias("hashed"))


def _depth_sql(depth: int) -> str:
    return f"select vec_id, {depth} depth, cast(sum(s & {(1 << depth) - 1}) as bigint) total, {64 * depth // 8} bytes, sha256(string_agg(lpad(bin(s & {(1 << depth) - 1}), {depth}, '0'), '' order by x)) bits from g group by 1"


@query(f"with g as (select y vec_id, x, s * 13 s, count(*) over (partition by y) n from ({GRID_SQL})), k as (select * from g where n = 64) " + " union all ".join(_depth_sql(d).replace("from g", "from k") for d in samples.DEPTHS))
def sample_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples packed at every depth: the sum of what is read back, and the packed bits."""
    columns.register(spark)
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    deep = rows.select("vec_id", F.transform("embedding", lambda e: level_of(e) * 13).alias("levels"), F.explode(F.array(*[F.lit(d) for d in samples.DEPTHS])).alias("depth"))
    masked = deep.select("vec_id", "depth", F.transform("levels", lambda v: v.bitwiseAND((columns.mask(F.col("depth"))).cast("int"))).alias("levels"))
    packed = masked.select("vec_id", "depth", F.call_function("raw_pack", "levels", "depth", F.lit("Big")).alias("packed"))
    back = packed.select("vec_id", "depth", "packed", F.call_function("raw_unpack", "packed", "depth", F.lit("Big"), F.lit(64)).alias("levels"))
    digits = F.transform(F.sequence(F.lit(1), F.octet_length("packed")), lambda k: F.lpad(F.conv(F.hex(F.substring("packed", k, F.lit(1))), 16, 2), 8, "0"))
    total = F.aggregate("levels", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return back.select("vec_id", "depth", total.alias("total"), F.octet_length("packed").alias("bytes"), F.sha2(F.array_join(digits, ""), 256).alias("bits"))
