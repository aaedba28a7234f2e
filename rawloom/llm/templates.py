"""Benchmark decontamination: typed placeholders, a hash join of template windows, slot consistency."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rawloom.llm.batches import blocks, raw
from rawloom.llm.words import Words, mix, word_hash, words
from rawloom.session import fresh, materialise, ship

#: Words of a template window, and the share of an item's windows that a document must have.
WINDOW, CONTAINED = 5, 0.8
#: Hashes of benchmark windows that may come to the driver to make a filter; beyond, all windows are joined.
FILTER_MOST = 4_000_000
#: Bits of the filter for each hash, at least.
FILTER_BITS = 16

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts".split()
#: Words that may stand inside a name.
PARTICLES = "of de da di du del la le van von der den and y".split()
#: Kinds of slot; 0 is an ordinary word.
NUMBER, UNIT, NAME = 1, 2, 3
#: Views of a text: what becomes a placeholder in it.
PLAIN, VALUES, NAMES = 0, 1, 2
#: Ordinary words that an item needs in a view with placeholders.
LEAST_PLAIN = 8
#: Alignments of an item that are at most this many tokens apart are one place.
NEAR = 8
_KIND_HASH = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F], np.uint64)
_SETS: dict[str, np.ndarray] = {}


def _known(kind: str, listed: list[str]) -> np.ndarray:
    if kind not in _SETS:
        _SETS[kind] = np.sort(np.array([word_hash(w) for w in listed], np.uint64))
    return _SETS[kind]


def kinds_of(found: Words) -> np.ndarray:
    """The kind of slot of each word.

    NUMBER: a word that starts with a digit, or a number word.  NAME: a capital letter and then a small one, wherever it
    stands, as a name may begin a sentence, and a particle between two such words.  UNIT: a unit word, or any other word right after a NUMBER."""
    data, starts, ends = found.data, found.starts, found.ends
    if not len(starts):
        return np.zeros(0, np.uint8)
    lead = data[starts]
    number = ((lead >= 48) & (lead <= 57)) | np.isin(found.hashes, _known("number", NUMBER_WORDS))
    unit = np.isin(found.hashes, _known("unit", UNIT_WORDS))
    unit[1:] |= number[:-1] & (found.doc[1:] == found.doc[:-1])
    wide = lead == 0xC3
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | (wide & (second >= 0x80) & (second <= 0x9E))
    after = np.minimum(starts + 1 + wide, len(data) - 1)
    small = (after < ends) & (((data[after] >= 97) & (data[after] <= 122)) | (data[after] >= 0x80))
    kinds = np.zeros(len(starts), np.uint8)
    kinds[unit] = UNIT
    kinds[capital & small] = NAME
    kinds[number] = NUMBER
    name = kinds == NAME
    inside = np.isin(found.hashes[1:-1], _known("particle", PARTICLES)) & name[:-2] & name[2:] & (found.doc[:-2] == found.doc[2:])
    kinds[1:-1][inside & (kinds[1:-1] == 0)] = NAME
    return kinds


@dataclass
class Tokens:
    """A view of texts: for each token its hash, kind, words (from, to) and text; first: of each text (one more at the
    end)."""

    hashes: np.ndarray
    kinds: np.ndarray
    word: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def tokens_of(found: Words, kinds: np.ndarray, view: int) -> Tokens:
    """PLAIN: every word as it is.  VALUES: numbers and units are placeholders.  NAMES: names as well.

    Numbers, and names, that follow one another in a sentence are one placeholder, so that `Boston` may become
    `New York` and `12` may become `two hundred`."""
    slot = np.zeros_like(kinds) if view == PLAIN else np.where(kinds == NAME, 0, kinds) if view == VALUES else kinds
    joined = np.zeros(len(slot), bool)
    if len(slot) > 1:
        stops = np.cumsum(np.isin(found.data, np.frombuffer(b".!?:;\"", np.uint8)))
        joined[1:] = (slot[1:] == slot[:-1]) & ((slot[1:] == NUMBER) | (slot[1:] == NAME)) & (found.doc[1:] == found.doc[:-1]) & (stops[found.starts[1:] - 1] == stops[found.ends[:-1] - 1])
    word = np.flatnonzero(~joined)
    hashes = np.where(slot > 0, _KIND_HASH[slot], found.hashes)[word]
    return Tokens(hashes, slot[word], word, np.append(word[1:], len(slot)), found.doc[word], np.searchsorted(word, found.first))


def template_windows(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the windows of `size` tokens of every text."""
    n = len(tokens.hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(tokens.doc[:n] == tokens.doc[size - 1 :])
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += tokens.hashes[k : n + k]
    return at, mix(total[at])


def _slots(found: Words, tokens: Tokens, first: int, size: int) -> list[str]:
    """The values of the slots of a window, in order."""
    return [" ".join(found.text(j).decode("utf-8", "replace").lower() for j in range(tokens.word[k], tokens.end[k])) for k in range(first, first + size) if tokens.kinds[k]]


def _members(hashes: np.ndarray) -> np.ndarray:
    """A bit table of the hashes."""
    size = 1 << max(16, int(len(hashes) * FILTER_BITS).bit_length())
    table = np.zeros(size // 8, np.uint8)
    at = hashes & np.uint64(size - 1)
    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    return table


def _may_have(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


SCHEMA = "view int, pos long, size int, hash long, slots array<string>, n long, plain long"


def windows_of(rows: DataFrame, id_col: str, text_col: str, sizes: list[int] | None, keep=None) -> DataFrame:
    """(id, view, pos, size, hash, slots, n, plain) of the template windows of whole texts, in each view.

    pos counts tokens of the view; n and plain: tokens of the text, and those that are no slot.  sizes None: windows of
    WINDOW tokens, and for a shorter text one window of all its tokens.
    keep: a broadcast bit table; windows that it can't have are left out, which no join would find anyway."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = keep.value if keep is not None else None
        for part in blocks(batches, text_col, 1 << 20):
            found = words(raw(part, text_col))
            kinds = kinds_of(found)
            columns: list[list] = [[] for _ in range(8)]
            for view in (PLAIN, VALUES, NAMES):
                tokens = tokens_of(found, kinds, view)
                count = np.diff(tokens.first)
                plain = np.diff(np.concatenate(([0], np.cumsum(tokens.kinds == 0)))[tokens.first])
                for size in sizes or range(1, WINDOW + 1):
                    at, hashes = template_windows(tokens, size)
                    if sizes is None and size < WINDOW:
                        ok = count[tokens.doc[at]] == size
                        at, hashes = at[ok], hashes[ok]
                    if table is not None:
                        ok = _may_have(table, hashes)
                        at, hashes = at[ok], hashes[ok]
                    docs = tokens.doc[at]
                    made = (docs, np.full(len(at), view), at - tokens.first[docs], np.full(len(at), size), hashes.view(np.int64), [_slots(found, tokens, int(a), size) for a in at], count[docs], plain[docs])
                    for column, x in zip(columns, made, strict=True):
                        column.append(x)
            kinds_ = ((1, pa.int32()), (2, pa.int64()), (3, pa.int32()), (4, pa.int64()))
            made = [pa.array(np.concatenate(columns[k]), t) for k, t in kinds_]
            slots = pa.array([x for y in columns[5] for x in y], pa.list_(pa.string()))
            ids = part.column(0).take(pa.array(np.concatenate(columns[0]), pa.int64()))
            yield pa.record_batch([ids, *made, slots, *(pa.array(np.concatenate(columns[k]), pa.int64()) for k in (6, 7))], names=["id", "view", "pos", "size", "hash", "slots", "n", "plain"])

    return rows.select(id_col, text_col).mapInArrow(kernel, f"id {kind}, {SCHEMA}")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, windows, found, containment, same_values): documents that hold a benchmark item.

    Numbers, names and units become typed placeholders.  A document holds an item if, in one of three views (words as
    they are, numbers and units as placeholders, names too), at least CONTAINED of the item's windows of WINDOW tokens
    (an item of fewer tokens has a single one) occur in it.  A window with equal slot values counts in any case, one
    with other values where, along its alignment and those at most NEAR tokens off (something left out or put in), every
    slot value of the item goes with one value of the document: same_values tells whether all windows that count have
    equal values.  Items with fewer than LEAST_PLAIN ordinary words in a view with placeholders say too little there
    and are looked for word by word only.  Windows are compared as 64-bit hashes of templates.

    Every window of every text takes part, however long the text; the bit table of the benchmark's hashes, made when
    there are at most FILTER_MOST of them, only saves the join from windows that match nothing.  Null ids, null texts
    and texts without words match nothing; equal rows count once; of views that hold equally much the first counts;
    every (document, item) pair that holds is returned once; further columns are ignored; an empty side gives an empty
    table."""
    spark = docs.sparkSession
    every = windows_of(benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()), item_col, item_text, None)
    items = materialise(every.where((F.col("view") == PLAIN) | (F.col("plain") >= LEAST_PLAIN)).where((F.col("view") == PLAIN) | (F.col("plain") < F.col("n"))).distinct())
    stats = items.agg(F.countDistinct("hash").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes, keep = sorted(stats["sizes"]) or [WINDOW], None
    if stats["n"] <= FILTER_MOST:
        keep = spark.sparkContext.broadcast(_members(items.select("hash").distinct().toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))
    found = windows_of(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, sizes, keep)
    sides = items.select(F.col("id").alias("item"), "view", F.col("pos").alias("q"), "size", "hash", F.col("slots").alias("item_slots"))
    joined = found.select("id", "view", "pos", "size", "hash", "slots").join(sides, ["hash", "size", "view"]).where(F.size("slots") == F.size("item_slots"))
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    verbatim = F.when(F.col("slots") == F.col("item_slots"), F.col("q"))
    whole = ["id", "item", "view"]
    lined = joined.groupBy(*whole, (F.col("pos") - F.col("q")).alias("shift")).agg(F.collect_set("q").alias("all"), F.collect_set(verbatim).alias("equal"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    order = Window.partitionBy(*whole).orderBy("shift")
    apart = F.when(F.col("shift") - F.lag("shift").over(order) <= NEAR, 0).otherwise(1)
    placed = lined.withColumn("apart", apart).withColumn("place", F.sum("apart").over(order))
    merged = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("all", "equal", "pairs")]
    lined = placed.groupBy(*whole, "place").agg(*merged)
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    same = ~consistent | F.forall("pairs", lambda p: p["a"] == p["b"])
    counted = lined.select(*whole, F.when(consistent, F.col("all")).otherwise(F.col("equal")).alias("qs"), same.alias("same")).where(F.size("qs") > 0)
    total = items.select(F.col("id").alias("item"), "view", "pos").distinct().groupBy("item", "view").agg(F.count("*").alias("windows"))
    held = counted.groupBy(*whole).agg(F.size(F.array_distinct(F.flatten(F.collect_set("qs")))).cast("long").alias("found"), F.min("same").alias("same_values"))
    scored = held.join(total, ["item", "view"]).withColumn("containment", F.col("found") / F.col("windows")).where(F.col("containment") >= CONTAINED)
    best = scored.groupBy("id", "item").agg(F.max_by(F.struct("windows", "found", "containment", "same_values"), F.struct("containment", -F.col("view"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.windows", "b.found", "b.containment", "b.same_values")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; rows with a null id stay."""
    (name,) = fresh(docs, "_hit")
    # Written first, so that its size is known and a small one is broadcast: then no text moves.
    hit = materialise(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(name)).distinct())
    return docs.join(hit, F.col(id_col) == F.col(name), "left_anti")
