"""SimHash near-duplicates found through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, raw
from rawloom.llm.components import connected_components
from rawloom.session import fresh, materialise, quoted, ship

BITS = 64
#: Fingerprints at this Hamming distance or less are linked.
THRESHOLD = 3
#: The perfect Hamming code of length 31: covering radius 1, 2^26 codewords.
CODE_LENGTH, RADIUS = 31, 1
#: Shingle hashes that are counted at once, which bounds the memory of a very long text.
STEP = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half of the shingles' XXH64.

    ASCII letters are lower-cased; words are runs without ASCII white space; a text of fewer words than a
    shingle has its whole sequence as the only shingle; a text without words has fingerprint 0."""
    found = text.lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; a null text counts as empty."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col):
            fps = np.array([fingerprint(x) for x in raw(part, text_col)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"id {kind}, fp long")


def _syndromes() -> np.ndarray:
    """For each byte position and value, the XOR of the numbers (1 to 31) of the set bits."""
    out = np.zeros((4, 256), np.uint8)
    for k in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * k + bit < CODE_LENGTH:
                    out[k, value] ^= 8 * k + bit + 1
    return out


def _patterns() -> list[np.ndarray]:
    """For each syndrome, the error patterns of weight up to RADIUS + 1 that lead from a word to a codeword."""
    out = [[] for _ in range(CODE_LENGTH + 1)]
    out[0].append(0)
    for i in range(1, CODE_LENGTH + 1):
        out[i].append(1 << (i - 1))
        for j in range(i + 1, CODE_LENGTH + 1):
            out[i ^ j].append(1 << (i - 1) | 1 << (j - 1))
    return [np.array(x, np.uint64) for x in out]


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of uint64 fingerprints: (row, anchor).

    Of two fingerprints at distance 3 or less, one 32-bit half differs in at most 1 bit.  Either half, without
    its last bit, is replicated to every codeword within the covering radius plus 1, that is 2: the codeword
    nearest to one of the two (distance 1 at most) is then within 2 of the other, so they meet there."""
    tables, patterns = _syndromes(), _patterns()
    rows, anchors = [], []
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64((1 << CODE_LENGTH) - 1)
        syndrome = np.zeros(len(word), np.uint8)
        for k in range(4):
            syndrome ^= tables[k][((word >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)]
        for s in range(CODE_LENGTH + 1):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                made = (word[at][:, None] ^ patterns[s][None, :]) | np.uint64(half << 32)
                rows.append(np.repeat(at, len(patterns[s])))
                anchors.append(made.ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(anchors)


def forest(members: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links members at Hamming distance threshold or less.

    Breadth first over the members not yet reached, so that a dense group of n costs far fewer than n^2
    comparisons, n - 1 edges at most are made and memory is linear."""
    edges, left = [], members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= threshold
            if near.any():
                queue.extend(found := left[near])
                edges.extend((at, x) for x in found)
                left = left[~near]
    return edges


#: Runs of up to this many fingerprints are compared all at once, in numpy.
SHORT_RUN = 6
#: An anchor with more replicas than this is dealt anew, by the bytes of the other half.
HOT_ANCHOR = 2048


def _run_edges(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the runs of equal anchors of two sorted columns."""
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(anchor)]))
    size = ends - starts
    a, b = [], []
    length = np.repeat(size, size)
    for d in range(1, SHORT_RUN):
        ok = (anchor[d:] == anchor[:-d]) & (length[d:] <= SHORT_RUN)
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= THRESHOLD]
        a.append(fp[at])
        b.append(fp[at + d])
    for k in np.flatnonzero(size > SHORT_RUN):
        if found := forest(np.unique(fp[starts[k] : ends[k]])):
            pairs = np.array(found, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame) -> DataFrame:
    """(src, dst): links of distinct fingerprints (column fp) that connect just what Hamming distance 3 connects."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, anchors = anchors_of(fps)
            for at in range(0, len(rows), STEP):
                part = slice(at, at + STEP)
                yield pa.record_batch([pa.array(anchors[part].view(np.int64)), pa.array(fps[rows[part]].view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = fp = np.zeros(0, np.uint64)

        def out(a: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a) > 1:
                x, y = _run_edges(a, f)
                if len(x):
                    yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["src", "dst"])

        waiting: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, f = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            waiting.append((a, f))
            if a[0] == a[-1] and (len(waiting) == 1 or waiting[0][0][-1] == a[0]):
                continue  # still within one run
            anchor, fp = (np.concatenate(x) for x in zip(*waiting, strict=True))
            keep = int(np.searchsorted(anchor.view(np.int64), anchor.view(np.int64)[-1]))
            yield from out(anchor[:keep], fp[:keep])
            waiting = [(anchor[keep:], fp[keep:])]
        if waiting:
            anchor, fp = (np.concatenate(x) for x in zip(*waiting, strict=True))
            yield from out(anchor, fp)

    ship(nodes.sparkSession)
    held = materialise(nodes.select("fp").mapInArrow(replicate, "anchor long, fp long"))
    hot = materialise(held.groupBy("anchor").count().where(F.col("count") > HOT_ANCHOR).select("anchor"))
    # Two fingerprints that meet at an anchor differ in at most 3 bits of the other half, so one of its 4 bytes is equal.
    other = F.when(F.shiftrightunsigned("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = F.array(*[F.xxhash64("anchor", F.lit(k), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255).cast("long"))) for k in range(4)])
    split = held.join(hot, "anchor").select(F.explode(parts).alias("anchor"), "fp")
    dealt = held.join(hot, "anchor", "left_anti").unionAll(split).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs.

    Anchor-point covering: a covering code supplies the anchors, each distinct fingerprint is replicated to
    every anchor within covering radius plus threshold, and fingerprints are compared per anchor alone.
    Copies collapse to one fingerprint before replication; an anchor of more than HOT_ANCHOR fingerprints is dealt
    anew by the bytes of the other half, one of which two neighbours share, and a dense run makes a spanning forest,
    never all its pairs.  Very long texts are hashed whole, in bounded steps.  component_id is the smallest id that links reach.  Null texts count as empty; texts without
    words have fingerprint zero, linked like any other; rows repeat as they do in the input; a row whose id is
    null is kept and takes the smallest id of its component (null if there is none); other columns, whatever
    their names, are ignored; an empty table gives an empty table.
    """
    named = materialise(fingerprints(docs, id_col, text_col))
    nodes = named.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected_components(links(nodes))
    placed = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(least, "component").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return named.join(by_fp, "fp").select(F.col("id").alias(id_col), shown, "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, that of the smallest id and then hash of its text, of each component; rows whose id is null
    stay.

    Rows of one id with different texts are told apart; rows that repeat with the same id and text leave one.  What goes
    is written first, as hashes alone: where that is little it is broadcast, and no text moves.  Null and empty texts are
    near-duplicates of one another; very long texts count whole; an empty table gives an empty table; further columns are
    kept whatever their names."""
    (own,) = fresh(docs, "_own")
    keyed = docs.withColumn(own, F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))))
    found = near_duplicates(keyed.where(F.col(own).isNotNull()).select(own, text_col), own, text_col)
    rows = materialise(found.groupBy(F.col(own).alias("own")).agg(F.count("*").alias("n"), F.min(F.col("component_id") == F.col(own)).alias("first")))
    gone = materialise(rows.where("not first").select(F.col("own").alias(own)))
    again = materialise(rows.where("first and n > 1").select(F.col("own").alias(own)))
    kept = keyed.join(gone, own, "left_anti")
    single, repeated = kept.join(again, own, "left_anti"), kept.join(again, own, "left_semi")
    names = [F.col(quoted(c)) for c in docs.columns]
    return single.select(names).unionByName(repeated.dropDuplicates([own]).select(names))
