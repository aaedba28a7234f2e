import random
import re

import pytest

from rawloom.llm import licenses
from rawloom.llm.words import words
from tests.llm import data


def test_index_and_scan():
    rng = random.Random(5)
    index = licenses.index_of(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        plain = text.upper().replace(" ", "\n ")
        found = licenses.scan_texts(index, [data.prose(rng, 97).encode(), f"{data.prose(rng, 33)} {plain} {data.prose(rng, 41)}".encode(), b""])
        mine = [r for r in found if r[1] == name]
        assert mine and mine[0][0] == 1 and mine[0][2] == 1.0 and mine[0][5] == 1 and all(r[0] == 1 for r in found)


def test_changed_words():
    """Long notices are found with a word changed here and there; a quarter of the words changed is too much."""
    rng = random.Random(6)
    index = licenses.index_of(licenses.TEMPLATES)
    text = licenses.TEMPLATES["MIT/permission"].split()
    few, many = list(text), list(text)
    few[20] = "altered"
    for k in range(0, len(many), 4):
        many[k] = f"altered{k}"
    found = licenses.scan_texts(index, [(data.prose(rng, 50) + " " + " ".join(x)).encode() for x in (few, many)])
    assert [r[0] for r in found] == [0] and 0.8 <= found[0][2] < 1


def test_places_are_counted():
    index = licenses.index_of({"A/b": "one two three four five six"})
    found = licenses.scan_texts(index, [b"x " * 40 + b"one two three four five six " + b"y " * 40 + b"one two three four five six"])
    assert [(r[2], r[3], r[4], r[5]) for r in found] == [(1.0, 40, 6, 2)]


def test_scan(spark):
    rows = [(0, "Released under the MIT License.\nmore", "en", "s", 0), (None, "x. licensed under CC BY-NC 4.0", "en", "s", 0), *data.documents(), (0, "Released under the MIT License.\nmore", "en", "s", 0)]
    found = sorted(((r["doc_id"], r["license"], r["first_word"], r["n_words"]) for r in licenses.scan(data.frame(spark, rows, True)).collect()), key=str)
    assert found == [(0, "MIT", 0, 5), (0, "MIT", 0, 5), (None, "CC-BY-NC-4.0", 1, 6)]
    assert licenses.scan(data.empty(spark)).count() == 0


def slow_scan(text, templates):
    """Names of the templates of whose shingles the text has 0.8, by sets of all shingles."""
    cut = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"(?:[0-9a-z]|(?<=[0-9])[.,](?=[0-9]))+", t.lower())] for i in range(len(w) - 4)}
    have = cut(text)
    return {name: len(have & want) / len(want) for name, t in templates.items() if (want := cut(t))}


def test_equals_brute_force_on_altered_notices():
    """Of altered notices those are found that have 0.8 of a template's shingles, and no others."""
    rng = random.Random(7)
    index = licenses.index_of(licenses.TEMPLATES)
    near = 0
    for _ in range(400):
        words = licenses.TEMPLATES[rng.choice(list(licenses.TEMPLATES))].split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = rng.choice([["altered"], [], ["two", "more"]])
        text = f"{data.prose(rng, rng.randint(0, 60))} {' '.join(words)} {data.prose(rng, rng.randint(0, 60))}"
        want = {name: x for name, x in slow_scan(text, licenses.TEMPLATES).items() if x >= 0.8}
        near += sum(x < 1 for x in want.values())
        got = {r[1]: r[2] for r in licenses.scan_texts(index, [text.encode()])}
        assert got == want
    assert near > 50


def test_every_template_is_found_through_its_bands():
    """Windows of the grid of any copy collide with the template's, whatever stands before it."""
    rng = random.Random(8)
    index = licenses.index_of(licenses.TEMPLATES)
    for t, text in enumerate(licenses.TEMPLATES.values()):
        for before in range(8):
            found = words([(data.prose(rng, before + 1) + " " + text).encode()])
            assert (0, t) in licenses.candidates(index, found)


def test_a_table_of_templates_and_a_very_long_text(spark):
    rng = random.Random(9)
    table = spark.createDataFrame([("Own/notice", "All rights to this text are kept by its author."), ("MIT/notice", licenses.TEMPLATES["MIT/notice"])], "template string, text string")
    long = data.prose(rng, 60_000) + "\nAll rights to this text are kept by its author.\n" + data.prose(rng, 60_000)
    rows = [(0, long, "en", "s", 0), (1, "Released under the MIT License.", "en", "s", 0)]
    assert sorted((r["doc_id"], r["template"]) for r in licenses.scan(data.frame(spark, rows), table).collect()) == [(0, "Own/notice"), (1, "MIT/notice")]
    assert licenses.scan(data.frame(spark, rows), table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.index_of({"A/b": "too short"})
