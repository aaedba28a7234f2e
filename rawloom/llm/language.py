"""Language identification with a blended-spectrum string kernel, Nystrom landmarks and kernel ridge regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, text_blocks, texts
from rawloom.llm.learning import sample_per_class
from rawloom.session import discard, fresh, materialise, quoted, ship

UNKNOWN = "und"
#: Letters fall into this many classes: 0 what is no letter, 1 to 26 a to z, the others by a hash of the code point.
LETTERS = 64
#: Lengths of the n-grams whose presence the kernel compares; every length counts alike.
GRAMS = (1, 2, 3)
OFFSETS = np.cumsum([0, *(LETTERS**p for p in GRAMS)])
#: Training rows of each language; landmarks of each language, and of all of them at most (one a language at least).
TRAIN, LANDMARKS, MOST_LANDMARKS = 400, 64, 512
RIDGE = 1e-3
#: Windows scored by one matrix product.
BATCH = 128
#: A text is scored in windows of this many characters at most, equal in size, so that a foreign passage or sheer
#: length does not blur the presence vector; the whole text's score is their mean.
WINDOW = 800

_CLASSES: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """The class of every code point, built once for each worker from the rule above."""
    if not _CLASSES:
        points = np.arange(0x110000, dtype=np.uint64)
        table = (27 + (points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(LETTERS - 27)).astype(np.uint8)
        table[[not chr(c).isalpha() for c in range(0x110000)]] = 0
        table[97:123] = np.arange(1, 27)
        _CLASSES.append(table)
    return _CLASSES[0]


def windows(text: str) -> list[np.ndarray]:
    """The letter classes of the windows of a text."""
    codes = letter_classes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    n = -(-len(codes) // WINDOW)
    return np.array_split(codes, n) if n else []


def presence(codes: np.ndarray) -> np.ndarray:
    """Which n-grams of letter classes a window has; n-grams of only non-letters don't count."""
    flags = np.zeros(OFFSETS[-1], bool)
    gram = codes
    for k, p in enumerate(GRAMS):
        if k:
            gram = gram[:-1] * LETTERS + codes[p - 1 :]
        flags[OFFSETS[k] + gram] = True
    flags[OFFSETS[:-1]] = False
    return flags


@dataclass
class LanguageModel:
    """classes; the n-grams (columns) that any landmark has; the landmarks as columns of features; weights."""

    classes: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float

    def scores(self, flags: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest scores: kernel values against the landmarks, times the ridge weights."""
        return (features(flags, self.columns) @ self.landmarks) @ self.weights

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores.astype(np.float64) * self.sharpness
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def features(flags: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the kernel: for each n-gram length the cosine of the presence vectors."""
    out = np.zeros((len(flags), len(columns)), np.float32)
    length = np.searchsorted(OFFSETS, columns, side="right") - 1
    for row, x in zip(out, flags, strict=True):
        scale = [1 / np.sqrt(len(GRAMS) * max(1, np.count_nonzero(x[a:b]))) for a, b in zip(OFFSETS, OFFSETS[1:], strict=False)]
        np.multiply(x[columns], np.array(scale, np.float32)[length], out=row)
    return out


def stored(flags: np.ndarray) -> bytes:
    """Presence flags in a few kilobytes."""
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def restored(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=OFFSETS[-1]).astype(bool)


def similarities(flags: list[np.ndarray], columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of windows and landmarks, by products of BATCH windows."""
    made = [features(flags[i : i + BATCH], columns) @ landmarks for i in range(0, len(flags), BATCH)]
    return np.concatenate(made) if made else np.zeros((0, landmarks.shape[1]), np.float32)


def mean_similarity(text: str, columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray | None:
    """The mean of the kernel values of all windows of a text, weighted by their letters; None without letters."""
    total, letters, cut = np.zeros(landmarks.shape[1]), 0, windows(text)
    for i in range(0, len(cut), BATCH):
        part = cut[i : i + BATCH]
        weight = np.array([np.count_nonzero(w) for w in part], np.float64)
        total += weight @ similarities([presence(w) for w in part], columns, landmarks)
        letters += weight.sum()
    return total / letters if letters else None


def fit_rows(classes: list[str], columns: np.ndarray, landmarks: np.ndarray, langs: list[str], known: np.ndarray) -> LanguageModel:
    """Kernel ridge regression on one row (mean kernel values with the landmarks) for each training text."""
    target = np.array([[1.0 if lang == c else -1.0 for c in classes] for lang in langs])
    square = landmarks.T.astype(np.float64) @ landmarks
    left = known.T @ known + RIDGE * len(langs) * square + 1e-8 * np.trace(square) * np.eye(len(square))
    weights = np.linalg.solve(left, known.T @ target)
    scores = known @ weights
    right = target.argmax(axis=1)

    def loss(sharpness: float) -> float:
        z = scores * sharpness
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), right]))

    sharpness = min((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    return LanguageModel(classes, columns, landmarks, weights.astype(np.float32), sharpness)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample: about TRAIN rows of each language among the rows where `learn` holds.

    The sample is written to the shared folder once, so that the corpus is read for the counts of languages (two narrow
    columns) and for the sample alone.  One window of each of the first LANDMARKS rows of a language (by a hash of the
    id; fewer where there are more than MOST_LANDMARKS / LANDMARKS languages) comes to the driver as a landmark; then
    each row's whole text is compared with the landmarks where it lies, and its mean kernel values come to the driver:
    one vector a row, however long its text.  Rows with a null id, text or language teach nothing, nor do texts without
    letters; equal texts teach the same, and rows that repeat count as often as they do; ties between rows of one hash
    are ordered by text; without any row the model knows no language."""
    ship(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = sample_per_class(rows, lang_col, id_col, TRAIN).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("rank"), F.col(text_col).alias("text"))
    sample = materialise(chosen.where(F.col("text").rlike(r"\p{L}")))
    classes = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not classes:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), 1.0)
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(classes)))
    first = sample.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("rank")), 1, each).alias("ranks"))
    marked = sample.join(F.broadcast(first.select("lang", F.explode("ranks").alias("rank")).distinct()), ["lang", "rank"]).select("lang", "rank", "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            found = []
            for rank, text in zip(part.column(1).to_pylist(), texts(part, "text"), strict=True):
                cut = [w for w in windows(text) if np.any(w)]
                found.append(stored(presence(cut[rank % len(cut)])) if cut else None)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["lang", "rank", "flags"])

    made = [r for r in marked.mapInArrow(mark, "lang string, rank long, flags binary").collect() if r["flags"]]
    made = sorted((r["lang"], r["rank"], bytes(r["flags"])) for r in made)
    marks = [restored(x) for c in classes for x in [x for lang, _, x in made if lang == c][:each]]
    if not marks:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), 1.0)
    columns = np.flatnonzero(np.logical_or.reduce(marks))
    landmarks = features(marks, columns).T.copy()
    shared = docs.sparkSession.sparkContext.broadcast((columns, landmarks))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            found = [mean_similarity(text, *shared.value) for text in texts(part, "text")]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.list_(pa.float64()))], names=["lang", "rank", "known"])

    rows_ = [r for r in sample.select("lang", "rank", "text").mapInArrow(compare, "lang string, rank long, known array<double>").collect() if r["known"] is not None]
    rows_ = sorted((r["lang"], r["rank"], r["known"]) for r in rows_)
    discard(sample)
    shared.unpersist()
    return fit_rows(classes, columns, landmarks, [lang for lang, _, _ in rows_], np.array([x for _, _, x in rows_]))


def predict_texts(model: LanguageModel, found: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score (the probability of that language; 0 for unknown) of texts."""
    cut = [windows(x) for x in found]
    codes = [w for x in cut for w in x]
    if not model.classes or not codes:
        return [UNKNOWN] * len(found), np.zeros(len(found))
    scores = np.concatenate([model.scores([presence(w) for w in codes[i : i + BATCH]]) for i in range(0, len(codes), BATCH)])
    letters = np.array([np.count_nonzero(w) for w in codes], np.float64)
    doc = np.repeat(np.arange(len(found)), [len(x) for x in cut])
    total = np.bincount(doc, letters, len(found))
    mean = np.zeros((len(found), len(model.classes)))
    np.add.at(mean, doc, scores * letters[:, None])
    p = model.probabilities(mean / np.maximum(total, 1)[:, None])
    best, known = p.argmax(axis=1), total > 0
    return [model.classes[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred and lang_score, from the whole text alone.

    `und` with score 0 stands for a null text, one without letters, and every text where no language was learnt.
    Equal texts get the same language; of languages with equal scores the first in the alphabet is predicted; a very
    long text is scored window by window; rows repeat as in the input; columns of docs that are called lang_pred or
    lang_score are replaced, all others, whatever their names and types, never leave the JVM; an empty table gives an
    empty table."""
    ship(docs.sparkSession)
    kept = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(found: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in found:
            out = [predict_texts(shared.value, part) for part in text_blocks(series)]
            langs = [x for names, _ in out for x in names]
            scores = np.concatenate([x for _, x in out]) if out else np.zeros(0)
            yield pd.DataFrame({"lang_pred": langs, "lang_score": scores})

    (name,) = fresh(kept, "_found")
    # Not to be moved below a filter on its results, where it would run a second time.
    made = kept.withColumn(name, predict.asNondeterministic()(F.col(quoted(text_col))))
    return made.select(*[F.col(quoted(c)) for c in kept.columns], F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.lang_score").alias("lang_score"))
