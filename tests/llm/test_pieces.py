import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from rawloom.llm import pieces
from rawloom.llm.queries import piece_model
from tests.llm import data

ODD = [*" ▁ab\n\t\r\x00é中　😀.,01", "  ", "the", "<s>", "</s>", "<unk>", "​", "ﬁ", "①", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_table_equals_the_library(library):
    rng = random.Random(3)
    table = pieces.ChunkTable(piece_model())
    texts = ["", " ", "  ", "a ", " a", "a  b", "▁", "▁ a▁b"] + ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(3000)]
    for text, (ids, back) in zip(texts, table.encode_all(texts), strict=True):
        want = library.encode(text)
        assert ids.tolist() == want and back == library.decode(want), repr(text)


def test_long_texts_in_segments(library, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(pieces, "SEGMENT", 100)
    text = "".join(rng.choices(ODD, k=5000))
    assert all(" ".join(pieces.segments(t, 50)) == t for t in (text, "", "x" * 500, "a  " * 100))
    ids, back = pieces.ChunkTable(piece_model()).encode(text)
    assert ids.tolist() == library.encode(text) and back == library.decode(library.encode(text))


def test_small_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_CHUNKS", 5)
    table = pieces.ChunkTable(piece_model())
    for text in ("one two three four five six", "seven eight", "one two nine"):
        assert table.encode(text)[0].tolist() == library.encode(text)


def test_digests(spark, library):
    rows = data.documents()
    found = pieces.digests(pieces.encode(data.frame(spark, rows, True), piece_model())).collect()

    def want(r):
        ids = library.encode(r[1] or "")
        return (r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    assert sorted(map(tuple, found), key=str) == sorted(map(want, rows), key=str)
    assert pieces.digests(pieces.encode(data.empty(spark), piece_model())).count() == 0
