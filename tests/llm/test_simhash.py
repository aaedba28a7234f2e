import numpy as np
import pytest
import xxhash

from rawloom.llm import simhash
from rawloom.llm.components import connected_components
from tests.llm import data


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "Two WORDS", "É three words", "a b c d e f " * 50, "x\x0by\x0cz w"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_anchors_cover():
    """Any two fingerprints at distance 3 or less share an anchor."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.where(rng.random(len(a)) < 0.9, np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64), np.uint64(0))
    (ra, xa), (rb, xb) = simhash.anchors_of(a), simhash.anchors_of(b)
    shared = {(int(r), int(x)) for r, x in zip(ra, xa, strict=True)} & {(int(r), int(x)) for r, x in zip(rb, xb, strict=True)}
    assert {r for r, _ in shared} == set(range(len(a)))


def test_forest_connects_like_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        members = np.unique(rng.integers(0, 1 << 10, 60, dtype=np.uint64))
        edges = simhash.forest(members, 2)
        assert len(edges) < len(members)
        ids = list(range(len(members)))
        parent = {int(m): int(m) for m in members}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            assert (int(a) ^ int(b)).bit_count() <= 2
            parent[find(int(a))] = find(int(b))
        for i in ids:
            for j in ids[:i]:
                if (int(members[i]) ^ int(members[j])).bit_count() <= 2:
                    assert find(int(members[i])) == find(int(members[j]))


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates_match_brute_force(spark, clash):
    rows = data.documents()
    found = simhash.near_duplicates(data.frame(spark, rows, clash)).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, slow_components(fps, [r[0] for r in rows]), strict=True)), key=str)
    assert sorted((tuple(r) for r in found), key=str) == want


def test_dense_group(spark):
    """Thousands of fingerprints around one centre: all linked to it and none beyond."""
    rng = np.random.default_rng(4)
    centre = 0x123456789ABCDEF0
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2)) if a != b} | {centre}
    far = {centre ^ (0xFF << 8)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near | far]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    groups = {r["node"]: r["component"] for r in connected_components(simhash.links(nodes)).collect()}
    to = lambda x: x - (1 << 64) if x >> 63 else x
    assert len({groups[to(x)] for x in near}) == 1 and to(next(iter(far))) not in groups


def test_empty_and_keep_first(spark):
    assert simhash.near_duplicates(data.empty(spark)).count() == 0
    rows = data.documents()
    kept = simhash.keep_first(data.frame(spark, rows, True))
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = {c for r, c in zip(rows, slow_components(fps, [r[0] for r in rows]), strict=True) if r[0] is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


def test_components_of_a_path(spark):
    n = 300
    rows = [(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert all(found[k] == 0 for k in range(n + 1)) and found[1001] == found[1000] == 1000 and 5000 not in found


def test_keep_first_tells_rows_of_one_id_apart(spark):
    """Two texts of one id in two components: each component keeps a row."""
    a = "one passage of text about the weather in the hills and the rain that falls on them in autumn"
    b = "completely other matter, namely ships that sail by night without any lamps along a rocky coast"
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a, "en", "s", 0), (3, b, "en", "s", 0), (1, a, "en", "s", 0), (None, a, "en", "s", 0)]
    kept = simhash.keep_first(data.frame(spark, rows))
    assert kept.columns == data.frame(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (None, a)], key=str)
