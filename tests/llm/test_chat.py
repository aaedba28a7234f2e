import itertools
import random

import pytest

from rawloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def legal(roles):
    at = ""
    for r in roles:
        if r not in chat.FOLLOWS[at]:
            return False
        at = r
    return at == chat.LAST or not roles


def slow_cost(roles):
    """The cheapest repair, over all assignments of roles and of merging, by exhaustion."""
    codes = [r if r in chat.ROLES else None for r in roles]

    def gap(a, b):
        frontier, n = [a], 0
        while n < 6:
            if any(b in chat.FOLLOWS[x] for x in frontier):
                return n
            frontier, n = [y for x in frontier for y in chat.FOLLOWS[x]], n + 1
        return None

    best = 1 << 40
    for given in itertools.product(chat.ROLES, repeat=len(codes)):
        cost, at = 0, ""
        for own, new in zip(codes, given, strict=True):
            cost += 0 if own == new else chat.NAME if own is None else chat.RELABEL
            steps = gap(at, new)
            ways = [chat.INSERT * steps] if steps is not None else []
            ways += [chat.MERGE] if at == new else []
            cost += min(ways, default=1 << 40)
            at = new
        if codes and at != chat.LAST:
            cost += chat.INSERT * (1 + gap(at, chat.LAST))
        best = min(best, cost)
    return best


def run(spark, rows, **other):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {}
    for r in chat.repair(df).collect():
        found.setdefault(r["conv_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["pos"]) for k, v in found.items()}


def check(turns):
    """Positions count up, and the repaired roles are legal."""
    assert [r["pos"] for r in turns] == list(range(len(turns)))
    roles = []
    for r in turns:
        if r["action"].endswith("merge"):
            assert roles[-1] == r["new_role"] and not r["inserted"]
        else:
            roles += [*r["inserted"], r["new_role"]]
        roles += r["appended"]
    assert legal(roles), roles


@pytest.mark.parametrize("run_length", [64, 2])
def test_costs_are_least(spark, monkeypatch, run_length):
    """Conversations cut into runs of two turns are repaired as well as whole ones."""
    monkeypatch.setattr(chat, "RUN", run_length)
    rng = random.Random(run_length)
    names = ["user", "assistant", "system", "tool", "narrator", None, " User "]
    convs = {k: [rng.choice(names) for _ in range(rng.randint(1, 5))] for k in range(60)}
    rows = [(k, n, r, f"{k}/{n}") for k, roles in convs.items() for n, r in enumerate(roles)]
    found = run(spark, rows)
    for k, roles in convs.items():
        check(found[k])
        plain = [None if r is None else r.strip().lower() for r in roles]
        assert sum(r["cost"] for r in found[k]) == slow_cost(plain), (roles, [(r["action"], r["new_role"]) for r in found[k]])


def test_one_huge_conversation(spark, monkeypatch):
    """All of it, and a turn number that thousands share, in runs of bounded size."""
    monkeypatch.setattr(chat, "MOST", 64)
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(3000)]
    rows += [(2, 7, "user", f"same {n}") for n in range(1500)] + [(2, 8, "assistant", "end"), (2, 6, "system", "start")]
    found = run(spark, rows)
    check(found[1])
    check(found[2])
    assert len(found[1]) == 3000 and sum(r["cost"] for r in found[1]) == 0
    assert len(found[2]) == 1502 and sum(r["cost"] for r in found[2]) == 1499 * chat.MERGE
    assert found[2][0]["role"] == "system" and found[2][-1]["text" if False else "role"] == "assistant"


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (3, None, "user", "first"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, None, None), (5, 0, "user", "x" * 100_000)]
    found = run(spark, rows)
    for turns in found.values():
        check(turns)
    assert [r["copies"] for r in found[3]] == [1, 2] and found[4][0]["new_role"] == "user" and found[4][0]["appended"] == ["assistant"]
    assert len(found[None]) == 2
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rendering(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "user", "again"), (1, 2, "assistant", "hi"), (1, 3, "user", "more")]
    text = chat.rendered(chat.repair(spark.createDataFrame(rows, SCHEMA))).first()
    a, z = chat.OPEN, chat.CLOSE
    assert text["rendered"] == f"{a}user\nhello\n\nagain{z}{a}assistant\nhi{z}{a}user\nmore{z}{a}assistant\n{z}" and text["cost"] == chat.MERGE + chat.INSERT
