"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, texts
from rawloom.session import ship

#: The white-space marker of SentencePiece; in a text it means the same as a space.
MARK = "▁"
#: A worker's table starts anew beyond so many chunks or characters, which bounds its memory and changes no result.
MAX_CHUNKS, MAX_CHARS = 400_000, 16 << 20
#: Characters of one text that are split at once.
SEGMENT = 4 << 20

_BREAK = re.compile(r"(?<=[^ ]) (?=[^ ])")
_TABLES: dict[str, ChunkTable] = {}


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut a long text at single spaces; the pieces joined by one space are the text."""
    start = 0
    while len(text) - start > size and (cut := _BREAK.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def chunks(text: str) -> list[str]:
    """The marked words of a text (spaces only, no markers), each without its first marker.

    A marked word is a run of markers and what follows up to the next marker, where the text itself gets one
    marker in front; '' stands for a marker alone.  The empty text has none."""
    if not text:
        return []
    found = text.split(" ")
    if "" not in found:
        return found
    out, gap = [], 0
    for word in found:
        if word:
            out.append(" " * gap + word)
            gap = 0
        else:
            gap += 1
    if gap:
        out.append(" " * (gap - 1))
    return out


class ChunkTable:
    """Ids and decoded text of each distinct chunk; no piece of the vocabulary crosses from a word into a marker."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(MARK in self.sp.id_to_piece(i).lstrip(MARK) for i in range(self.sp.vocab_size())):
            raise ValueError("pieces of this vocabulary cross white-space markers")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.odd: dict[str, str] = {}
        self.flat, self.starts, self.counts = (np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64))
        self.used = 0

    def _grow(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def add(self, words: Iterable[str]) -> None:
        """Segment each chunk that the table lacks, once."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if not new:
            return
        ids = self.sp.encode(new, num_threads=1)
        if "" in new:
            ids[new.index("")] = [self.sp.piece_to_id(MARK)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        at, total = len(self.place), int(counts.sum())
        for name, need in (("starts", at + len(new)), ("counts", at + len(new)), ("flat", self.used + total)):
            self._grow(name, need)
        self.counts[at : at + len(new)] = counts
        self.starts[at : at + len(new)] = self.used + np.cumsum(counts) - counts
        every = list(chain.from_iterable(ids))
        self.flat[self.used : self.used + total] = every
        self.used += total
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        self.chars += sum(map(len, new))
        # Ids of chunks one after the other decode to the chunks with a space between; only where they don't is
        # each chunk decoded by itself.
        if self.sp.decode(every, num_threads=1) != " ".join(new):
            self.odd.update((w, back) for w, x in zip(new, ids, strict=True) if w != (back := self.sp.decode(x, num_threads=1)))

    def encode_all(self, found: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, and the text that they decode to."""
        if len(self.place) > MAX_CHUNKS or self.chars > MAX_CHARS:
            self.clear()
        plain = [list(segments(text.replace(MARK, " "))) for text in found]
        cut = [[chunks(part) for part in parts] for parts in plain]
        self.add(chain.from_iterable(chain.from_iterable(parts) for parts in cut))
        return [self._joined(parts, words) for parts, words in zip(plain, cut, strict=True)]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        return self.encode_all([text])[0]

    def _joined(self, parts: list[str], cut: list[list[str]]) -> tuple[np.ndarray, str]:
        """Ids by position, and the decoded text, of the chunks of a text."""
        place = np.concatenate([np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)) for words in cut])
        if self.odd:
            parts = [" ".join([self.odd.get(w, w) for w in words]) for words in cut]
        counts = self.counts[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[place] - ends + counts, counts) + np.arange(total)], " ".join(parts)


def table_of(model: str) -> ChunkTable:
    """This worker's table."""
    if model not in _TABLES:
        _TABLES[model] = ChunkTable(model)
    return _TABLES[model]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text, as the library itself makes them.

    Pieces of the vocabulary do not cross from a word into a white-space marker (checked when the model is
    loaded), so each distinct marked word is segmented once by the library and its ids are joined back by
    position.  The table belongs to a worker and is bounded; nothing is shuffled.  A null text counts as empty
    and has no ids; U+2581 in a text is a space, as in the library; repeated rows, null ids and further columns
    pass without effect; a very long text is cut at spaces into segments, which are encoded in turn; equal texts get equal
    ids; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table_of(model)
        for part in blocks(batches, text_col, 2 << 20):
            made = known.encode_all(texts(part, text_col))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x, _ in made]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for x, _ in made]).astype(np.int32)))
            yield pa.record_batch([part.column(0), ids, pa.array([x for _, x in made], pa.string())], names=["id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Token counts and digests of what encode() returns, and if asked for the ids themselves."""
    return encoded.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )
