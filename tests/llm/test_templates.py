import random
import re

import pytest

from rawloom.llm import templates
from rawloom.llm.words import words
from tests.llm import data

ITEMS = [
    (0, "A train leaves Boston at 60 mph and travels for 3 hours before it stops. How many miles did it travel in all?"),
    (1, "Maria has 12 apples and gives 5 apples to John, then Maria buys 7 more. How many apples does Maria have now?"),
    (2, "plain words without any slot make a passage that is copied word for word into a document of the corpus"),
    (3, "too short"),
    (4, None),
    (None, "an item without an id is not looked for at all in here"),
    (5, ""),
]


def docs():
    rng = random.Random(8)
    fill = lambda: data.prose(rng, 40)
    one, two, three = ITEMS[0][1], ITEMS[1][1], ITEMS[2][1]
    return [
        (0, f"{fill()}\n{one}\n{fill()}", "en", "s", 0),
        (1, f"{fill()} {one.replace('60', '75').replace('3 hours', '9 hours').replace('Boston', 'Denver')} {fill()}", "en", "s", 0),
        (2, f"{fill()}\n{two.replace('12', '90').replace('Maria', 'Anna').replace('John', 'Peter')}", "en", "s", 0),
        (3, fill() + "\n" + three.upper(), "en", "s", 0),
        (4, fill(), "en", "s", 0),
        (5, " ".join(one.split()[:8]) + " " + fill(), "en", "s", 0),
        (6, two.replace("12", "90", 1).replace("then Maria", "then Anna"), "en", "s", 0),
        (7, two.lower(), "en", "s", 0),
        (8, "so this is too short, is it", "en", "s", 0),
        (None, one, "en", "s", 0), (9, None, "en", "s", 0), (10, "", "en", "s", 0), (0, f"{one}", "en", "s", 0), (11, "too short", "en", "s", 0),
    ]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_contaminated(spark, monkeypatch, most):
    """With and without the filter the same pairs are found."""
    monkeypatch.setattr(templates, "FILTER_MOST", most)
    found = {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(data.frame(spark, docs(), True), bench(spark)).collect()}
    assert set(found) == {(0, 0), (1, 0), (2, 1), (3, 2), (7, 1), (8, 3), (11, 3)}
    assert {k for k, r in found.items() if r["same_values"]} == {(0, 0), (3, 2), (7, 1), (8, 3), (11, 3)}
    assert all(0.8 <= r["containment"] <= 1 for r in found.values())


def test_decontaminate(spark):
    kept = templates.decontaminate(data.frame(spark, docs(), True), bench(spark))
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str) == sorted([4, 5, 6, None, 9, 10], key=str)
    assert templates.decontaminate(data.empty(spark), bench(spark)).count() == 0
    assert templates.decontaminate(data.frame(spark, docs()), bench(spark).limit(0)).count() == len(docs())


def test_kinds():
    found = words(["We paid 3.5 kg of Gold to Élodie. Then two knots IN all\nNew line 5kg, some miles".encode()])
    kinds = dict(zip([found.text(k).decode() for k in range(len(found.starts))], templates.kinds_of(found).tolist(), strict=True))
    want = {"We": 3, "paid": 0, "3.5": 1, "kg": 2, "of": 0, "Gold": 3, "to": 0, "Élodie": 3, "Then": 3, "two": 1, "knots": 2, "IN": 0, "all": 0, "New": 3, "line": 0, "5kg": 1, "some": 2, "miles": 2}
    assert kinds == want
    assert len(templates.kinds_of(words([b""]))) == 0


def test_runs_of_slots_are_one_token():
    texts = ["In New York two hundred men. Boston won 5 million, 3 nil".encode(), b"", b"Paris"]
    found = words(texts)
    tokens = templates.tokens_of(found, templates.kinds_of(found), templates.NAMES)
    assert [templates._slots(found, tokens, k, 1) for k in range(len(tokens.word))] == [["in new york"], ["two hundred"], ["men"], ["boston"], [], ["5 million 3"], ["nil"], ["paris"]]
    assert tokens.first.tolist() == [0, 7, 7, 8]


def slow_tokens(text, view):
    """[(template token, value or None)] of a text, one token after the other."""
    numbers, units, particles = set(templates.NUMBER_WORDS), set(templates.UNIT_WORDS), set(templates.PARTICLES)
    found = list(re.finditer(r"(?:[0-9A-Za-z\u0080-\uffff]|(?<=[0-9])[.,](?=[0-9]))+", text))
    kinds = []
    for m in found:
        word = m.group()
        if word[0] in "0123456789" or word.lower() in numbers:
            kinds.append("number")
        elif (word[0].isascii() or word[0] in "ÉÈÄÖÜ") and word[0].isupper() and len(word) > 1 and (word[1].islower() or ord(word[1]) > 127):
            kinds.append("name")
        else:
            kinds.append("unit" if word.lower() in units or kinds[-1:] == ["number"] else None)
    names = [k == "name" for k in kinds]
    for k in range(1, len(kinds) - 1):
        if kinds[k] is None and found[k].group().lower() in particles and names[k - 1] and names[k + 1]:
            kinds[k] = "name"
    out = []
    for k, m in enumerate(found):
        word, slot = m.group().lower(), None if view == 0 or (view == 1 and kinds[k] == "name") else kinds[k]
        stop = any(c in '.!?:;"' for c in text[found[k - 1].end() if k else 0 : m.start()])
        if out and slot in ("number", "name") and out[-1][0] == ("slot", slot) and not stop:
            out[-1] = (out[-1][0], f"{out[-1][1]} {word}")
        else:
            out.append((("slot", slot), word) if slot else (word, None))
    return out


def slow_contaminated(docs, items):
    """{(doc, item): (windows, found, same)} by comparing every window of every document with every one of every item."""
    best = {}
    cut = lambda t, n: [(i, tuple(x for x, _ in t[i : i + n]), [v for _, v in t[i : i + n] if v]) for i in range(len(t) - n + 1)]
    for view in (0, 1, 2):
        wanted = []
        for i, text in items:
            t = slow_tokens(text or "", view)
            plain = sum(v is None for _, v in t)
            if i is not None and t and (view == 0 or 8 <= plain < len(t)):
                wanted.append((i, min(5, len(t)), cut(t, min(5, len(t)))))
        for d in {(r[0], r[1]) for r in docs if r[0] is not None and r[1]}:
            t = slow_tokens(d[1], view)
            for i, n, windows in wanted:
                by = {}
                for pos, x, values in cut(t, n):
                    for q, y, other in windows:
                        if x == y:
                            by.setdefault(pos - q, []).append((q, list(zip(other, values, strict=True))))
                places, last = [], None
                for shift in sorted(by):
                    if last is None or shift - last > 8:
                        places.append([])
                    places[-1] += by[shift]
                    last = shift
                held, same = set(), True
                for place in places:
                    pairs = {p for _, ps in place for p in ps}
                    fits = len({a for a, _ in pairs}) == len(pairs)
                    qs = {q for q, ps in place if fits or all(a == b for a, b in ps)}
                    held |= qs
                    if qs:
                        same &= not fits or all(a == b for a, b in pairs)
                best.setdefault((d[0], i), {}).setdefault(view, []).append((held, len(windows), same))
    out = {}
    for key, views in best.items():
        for view, parts in sorted(views.items()):
            found, n, same = len(set().union(*[h for h, _, _ in parts])), parts[0][1], all(s for h, _, s in parts if h)
            if found >= 0.8 * n - 1e-12 and (key not in out or found / n > out[key][1] / out[key][0]):
                out[key] = (n, found, same)
    return out


def problems(n, seed=4):
    """Benchmark items with names, numbers and units, and the same with other ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    names = ["Natalia", "Anna", "Boston", "New York", "Peter", "Élodie", "San Marino", "Tom", "Rio de Oro", "Karl"]
    numbers = ["48", "two", "1,000", "3.5", "two hundred", "sixty", "7", "90 million", "15"]
    units = ["mph", "knots", "hours", "kg", "parsecs", "dollars", "apples", "miles"]
    items, changed = [], []
    for k in range(n):
        who, count = rng.sample(names, 6), rng.sample(numbers, 6)
        what = rng.sample(units, 4)
        a, b = [], []
        for s in range(rng.randint(2, 4)):
            for x, own in ((a, 0), (b, 3)):
                x.append(who[own + s % 3] if s % 2 == k % 2 else "Then")
            for _ in range(rng.randint(2, 4)):
                plain = [word() for _ in range(rng.randint(2, 4))]
                m, u, w = rng.randrange(3), rng.randrange(2), rng.randrange(3)
                a += [*plain, count[m], what[u], word_ := word(), who[w]]
                b += [*plain, count[m + 3], what[u + 2], word_, who[w + 3]]
            a[-1] += "."
            b[-1] += "."
        items.append((k, " ".join(a)))
        changed.append(" ".join(b))
    return items, changed


def test_other_parameters_are_found(spark):
    """Of 200 items with other names, numbers and units nine tenths at least are found, and no clean document."""
    rng = random.Random(5)
    items, changed = problems(200)
    rows = [(k, f"{data.prose(rng, 60)}\n{text} {data.prose(rng, 60)}", "en", "s", 0) for k, text in enumerate(changed)]
    clean, _ = problems(200, seed=99)
    rows += [(1000 + k, f"{data.prose(rng, 60)} {text}", "en", "s", 0) for k, text in clean]
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(data.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d for d, _ in got if d >= 1000} == set() and all(d == i for d, i in got)
    assert len(got) >= 180


def test_equals_brute_force(spark):
    """Every (document, item) pair with its counts, against all windows compared with all windows."""
    rng = random.Random(6)
    items, changed = problems(12)
    rows = []
    for k, (_, text) in enumerate(items):
        broken = changed[k].split(" ")
        for at in rng.sample(range(len(broken)), len(broken) // 12):
            broken[at] = "other"
        del broken[rng.randrange(len(broken))]
        for j, t in enumerate((text, text.lower(), changed[k], " ".join(broken), text + " " + changed[k], " ".join(text.split(" ")[: 10 + 3 * k]))):
            rows.append((10 * k + j, f"{data.prose(rng, 20)} {t} {data.prose(rng, 20)}", "en", "s", 0))
    rows += docs()
    items += [(100 + i, t) for i, t in ITEMS if i is not None]
    got = templates.contaminated(data.frame(spark, rows, True), spark.createDataFrame([*items, (None, "x")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["windows"], r["found"], r["same_values"]) for r in got} == slow_contaminated(rows, items)
    assert len(got) > 40


def test_word_hashes():
    texts = ["Über Straße, ÜBER x2", "", "über 1,000 3.5 straße", "a.b"]
    found = words([t.encode() for t in texts])
    seen = [found.text(k).decode() for k in range(len(found.starts))]
    assert seen == ["Über", "Straße", "ÜBER", "x2", "über", "1,000", "3.5", "straße", "a", "b"]
    assert found.hashes[0] == found.hashes[2] == found.hashes[4] and found.hashes[1] == found.hashes[7]
    assert len(set(found.hashes.tolist())) == 7 and found.first.tolist() == [0, 4, 4, 8, 10]
    assert found.prefixes(2)[0] == found.prefixes(2)[4]


def test_one_altered_occurrence(spark):
    """Windows that are copied verbatim count, though a name that occurs twice is altered once; others don't."""
    rng = random.Random(9)
    plain = [f"w{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(50)]
    words_ = [*plain[:20], "Maria", *plain[20:40], "Maria", *plain[40:]]
    item = " ".join(words_)
    once = " ".join([*words_[:41], "Anna", *words_[42:]])
    none = " ".join([*plain[:4], "Maria", *plain[4:8], "Maria", *plain[8:12], "Maria", *plain[12:16]])
    changed = " ".join([*plain[:4], "Anna", *plain[4:8], "Peter", *plain[8:12], "Paula", *plain[12:16]])
    rows = [(0, once, "en", "s", 0), (1, changed, "en", "s", 0)]
    items = spark.createDataFrame([(0, item), (1, none)], "item_id long, text string")
    got = templates.contaminated(data.frame(spark, rows), items).collect()
    assert [(r["doc_id"], r["item_id"], r["windows"], r["found"], r["same_values"]) for r in got] == [(0, 0, 48, 43, True)]
