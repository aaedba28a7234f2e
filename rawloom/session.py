"""Session and shared-storage helpers that every subpackage may use."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to Python, unless a single row has more.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
#: Whether Spark removes the shuffle files of a plan once it has run, without waiting for the driver's JVM to find it
#: unreachable.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Reading ranges of a local file at once goes through direct buffers, outside the heap, which every reading thread keeps
#: at the size of the largest column chunk it has read.
VECTORED = "parquet.hadoop.vectored.io.enabled"
#: Scratch tables written by this process; removed when it ends.
_SCRATCH: list[tuple[SparkSession, str]] = []


def local_session(cpus: int = 8, shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that kernels can be imported there."""
    context = spark.sparkContext
    # Arrow batches are bounded by bytes, as rows may be whole files or very long texts.
    found = re.fullmatch(r"(\d+)b?", spark.conf.get(BATCH_KEY))
    if not found or int(found[1]) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if getattr(context, "_rawloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="rawloom-")) / "rawloom.zip"
    with zipfile.ZipFile(to, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(to))
    context._rawloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's own readers touch the path."""
    ship(spark)
    return spark.read.option(VECTORED, "false").parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given column names, each with underscores added until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one if the master is
    local, else an error, as executors could not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rawloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the files survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _SCRATCH.append((spark, path))
    return spark.read.option(VECTORED, "false").schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that materialise() returned, once nothing reads it any more."""
    spark = df.sparkSession
    for at in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/scratch-" in at:
            _delete(spark, at)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return
