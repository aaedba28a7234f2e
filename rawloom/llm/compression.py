"""Quality from compression: zstandard dictionaries of good and of bad text, and a calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, raw
from rawloom.llm.learning import labelled, sample_per_class
from rawloom.session import ship

#: Texts are compressed in pieces of this many bytes, so that a long text does not teach the compressor itself.
PIECE = 1024
#: Bytes that are added to a text's size before the difference is divided by it: a short text says little.
SHRINK = 64
#: Bytes of a dictionary, and level of compression.
DICTIONARY, LEVEL = 96 << 10, 3
#: Labelled rows of each class for the dictionaries, and for the calibration; the two sets share no row.
DICT_ROWS, CALIBRATION_ROWS = 600, 1500


def cut(text: bytes) -> list[bytes]:
    """The pieces of a text: equal in size, PIECE bytes at most."""
    n = -(-len(text) // PIECE)
    size = -(-len(text) // n) if n else 0
    return [text[i * size : (i + 1) * size] for i in range(n)]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def __post_init__(self) -> None:
        self._made: list = []

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "slope": self.slope, "offset": self.offset}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _made=[])

    def _compressors(self) -> list:
        if not self._made:
            for words in (self.good, self.bad):
                book = zstandard.ZstdCompressionDict(words)
                book.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=book, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._made

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / (size without compression + SHRINK); empty: 0."""
        if not text:
            return 0.0
        good, bad = self._compressors()
        return sum(len(bad.compress(x)) - len(good.compress(x)) for x in cut(text)) / (len(text) + SHRINK)

    def score(self, text: bytes) -> float:
        """The calibrated probability of label 1."""
        return float(1 / (1 + np.exp(-(self.slope * self.difference(text) + self.offset))))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one variable, by damped Newton steps."""
    if not len(x):
        return 0.0, 0.0
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary from pieces of text; their concatenation where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """Fit on bounded samples of the labelled rows where `learn` holds: DICT_ROWS and CALIBRATION_ROWS of each class.

    The sampled ids are bounded by these parameters and so can be broadcast; the whole texts of the dictionary rows,
    in pieces, and the size differences of the others come to the driver.  Rows with a null id or label, and ids with
    both labels, teach nothing, a null text is empty; a very long text gives all its pieces; equal texts teach the same;
    ties in the order of pieces are equal pieces; where a class has too little text to train a dictionary on, its text
    itself, the last DICTIONARY bytes, is the dictionary."""
    ship(docs.sparkSession)
    known = labelled(labels, label, id_col, learn)
    chosen = sample_per_class(known, label, id_col, DICT_ROWS + CALIBRATION_ROWS, salt=4)
    share = DICT_ROWS / (DICT_ROWS + CALIBRATION_ROWS)
    side = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(41)), F.lit(10_000)) < int(10_000 * share)).alias("book")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast(kind), text_col).join(F.broadcast(chosen.select(id_col, F.col(label).cast("int").alias("y"), side)), id_col)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            out = []
            for y, text in zip(part.column(0).to_pylist(), raw(part, "text"), strict=True):
                out.extend((y, piece) for piece in cut(text))
            yield pa.record_batch([pa.array([y for y, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["y", "piece"])

    pieces = sorted((r["y"], bytes(r["piece"])) for r in rows.where("book").select("y", F.col(text_col).alias("text")).mapInArrow(spread, "y int, piece binary").collect())
    model = CompressionModel(dictionary([x for y, x in pieces if y == 1]), dictionary([x for y, x in pieces if y == 0]), 0.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            found = [model.difference(x) for x in raw(part, "text")]
            yield pa.record_batch([part.column(0), pa.array(found, pa.float64())], names=["y", "x"])

    measured = rows.where("not book").select("y", F.col(text_col).alias("text")).mapInArrow(measure, "y int, x double")
    found = sorted((r["y"], r["x"]) for r in measured.collect())
    base = {r["y"]: r["n"] for r in known.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    x, y = np.array([x for _, x in found]), np.array([float(y) for y, _ in found])
    model.slope, model.offset = platt(x, y)
    # Both classes were sampled alike: move the offset to their share among all labelled rows.
    drawn = [max(1.0, float((y == k).sum())) for k in (0, 1)]
    model.offset += float(np.log(max(1, base.get(1, 0)) / max(1, base.get(0, 0)) * drawn[0] / drawn[1]))
    return model


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, difference) of every whole text.

    score is the probability of label 1; a null text counts as empty, whose difference is 0.  Equal texts have
    equal scores; a very long text is compressed piece by piece; repeated rows, null ids and further columns, whatever
    their names, have no effect; an empty table gives an empty one.  Without labelled rows every score is 0.5."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col):
            x = np.array([shared.value.difference(t) for t in raw(part, text_col)])
            p = 1 / (1 + np.exp(-(shared.value.slope * x + shared.value.offset)))
            yield pa.record_batch([part.column(0), pa.array(p), pa.array(x)], names=["id", "score", "difference"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"id {kind}, score double, difference double")
