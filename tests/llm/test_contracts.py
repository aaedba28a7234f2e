"""The registered queries: columns, types and derived columns of what they return, and awkward frames for each operator."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rawloom.llm import chat, compression, language, licenses, lines, media, pieces, queries, simhash, templates, toxicity
from tests.llm import data
from tests.llm.test_templates import ITEMS

COLUMNS = {
    "op2_audio_features": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")],
    "op3_language_kernel": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op4_compression_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op5_simhash_anchors": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op9_toxicity_cnn": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op10_sentencepiece": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
}
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("contract"))
    rows = data.documents(200)
    spark.createDataFrame(rows, data.SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int(r[0] % 3 > 0), int(r[0] % 5 == 0)) for r in rows if r[0] is not None and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k // 5, k % 5, ("user", "assistant")[k % 2], f"text {k}") for k in range(40)], TURNS).write.parquet(f"{at}/conversations.parquet")
    return at, rows


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, folder, name):
    at, rows = folder
    found = queries.QUERIES[name](spark, at)
    assert found.dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    got = found.collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    fold, own = {"op3_language_kernel": (4, 2), "op4_compression_quality": (5, 0), "op9_toxicity_cnn": (4, 2)}.get(name, (1, 0))
    for r in got:
        if fold > 1:
            assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % fold == own)
            assert 0 <= r["score"] <= 1
        if "predicted" in r:
            assert r["predicted"] == int(r["score"] >= 0.3)
        if "lang_pred" in r:
            assert r["lang_pred"] in ("en", "de", "fr", "und")


def test_payloads(spark, folder):
    at, rows = folder
    texts = {(r[0], r[1] or "") for r in rows}
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in queries.op2_audio_features(spark, at).collect()}
    want = set()
    for i, text in texts:
        raw = text.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.add((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(COLUMNS)))
def test_other_queries_run(spark, folder, name):
    found = queries.QUERIES[name](spark, folder[0])
    assert found.count() >= 0 and len(set(found.columns)) == len(found.columns)


def odd(df):
    """Further columns whose names and types don't go through a schema string or to Python."""
    extra = {"a`b": F.lit(1), "x.y": F.lit("dot"), "pair": F.struct(F.lit(1).alias("a b")), "span": F.expr("interval 3 months"), "void": F.lit(None), "words": F.array(F.lit("w")), "key": F.lit(7), "doc": F.lit(0)}
    return df.withColumns({**{c: F.lit(v) for c, v in data.CLASHING.items()}, **extra})


def tiny(spark):
    return data.frame(spark, data.documents(20)[-40:])


def test_language_keeps_odd_columns(spark):
    docs = odd(tiny(spark))
    model = language.fit(docs, F.lit(True))
    found = language.identify(docs, model)
    assert found.columns == [c for c in docs.columns if c not in ("lang_pred", "lang_score")] + ["lang_pred", "lang_score"]
    assert found.where("lang_pred <> 'und'").count() > 0 and found.schema["span"].dataType == docs.schema["span"].dataType
    assert found.select("`x.y`", "`a``b`", "pair").distinct().count() == 1


def test_operators_take_odd_columns(spark):
    docs = odd(tiny(spark))
    labels = odd(spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int"))
    bench = odd(spark.createDataFrame(ITEMS, "item_id long, text string"))
    n = docs.count()
    assert lines.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert simhash.near_duplicates(docs).count() == n and simhash.keep_first(docs).columns == docs.columns
    assert templates.decontaminate(docs, bench).columns == docs.columns
    assert media.audio_features(docs).count() == pieces.encode(docs, queries.piece_model()).count() == n
    assert compression.score(docs, compression.fit(docs, labels, F.lit(True))).count() == n
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).count() == n
    assert licenses.scan(docs).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], TURNS)
    assert chat.repair(odd(turns).withColumns({"conv": F.lit("x"), "h": F.lit(1), "run": F.lit(2), "pos": F.lit(3)})).count() == 2


def test_toxicity_without_labels_and_with_one_class(spark):
    docs = tiny(spark)
    for rows in ([], [(k, 1) for k in range(20)], [(k, 0) for k in range(20)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), F.lit(True))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())


def test_toxicity_learns_from_very_long_texts(spark):
    """Labelled texts of any length teach: a class of long texts alone is told from short ones by its words."""
    rng = random.Random(3)
    rows = [(k, (data.prose(rng, 6000) + " vilest " + data.prose(rng, 300)) if k % 6 == 0 else data.prose(rng, 60), "en", "s", 0) for k in range(36)]
    assert min(len(r[1]) for r in rows if r[0] % 6 == 0) > 30_000
    docs = data.frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(36)], "doc_id long, toxic int"), F.lit(True))
    found = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum((found[k] >= 0.3) == (k % 6 == 0) for k in range(36)) >= 33


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_odd_columns(spark, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert run(spark, docs.limit(0), at).count() == 0
    wide = odd(docs.limit(40)).drop("lang_pred")
    found = run(spark, wide, at)
    assert 0 < found.count() <= 40 and (name == "tokens" or found.columns == wide.columns)


def test_shared_folder_is_asked_for(monkeypatch, spark):
    """Without spark.checkpoint.dir a folder of this machine is used on a local master alone."""
    from rawloom import session

    class Context:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Scala:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Scala

    class Fake:
        sparkContext = Context

    monkeypatch.setattr(Context, "getConf", staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d=None: d)})))
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake)
