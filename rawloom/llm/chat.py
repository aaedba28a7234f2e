"""Minimum-cost role repair of conversations, and their rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawloom.session import materialise, ship

ROLES = ("system", "user", "assistant", "tool")
#: States: 0 before the first turn, 1 + k after a turn of ROLES[k].  Code len(ROLES) is any other role, or none.
START, STATES, OTHER = 0, 1 + len(ROLES), len(ROLES)
#: What may follow: at the start, and after a turn of each role.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
#: A repaired conversation ends with a turn of this role.
LAST = "assistant"
#: Costs: merging a turn into the one before it, giving a turn another role, giving one to a turn without a known
#: role, and inserting an empty turn.
MERGE, RELABEL, NAME, INSERT = 2, 5, 1, 3
FAR = 1 << 40
#: Turns are dealt in runs of RUN turn numbers; a run of more than MOST turns is dealt by turn number and hash.
RUN, MOST = 64, 1024
OPEN, CLOSE, JOINT = "<|im_start|>", "<|im_end|>\n", "\n\n"


def _paths() -> dict[tuple[int, int], list[int]]:
    """The shortest sequences of inserted states between a state and the next turn's state (smallest states first)."""
    legal = {(0 if not a else 1 + ROLES.index(a)): [1 + ROLES.index(b) for b in after] for a, after in FOLLOWS.items()}
    out: dict[tuple[int, int], list[int]] = {}
    for s in range(STATES):
        frontier = [(s, [])]
        while frontier:
            ahead = []
            for at, path in frontier:
                for t in sorted(legal[at]):
                    if (s, t) not in out:
                        out[s, t] = path
                        ahead.append((t, [*path, t]))
            frontier = ahead
    return out


PATHS = _paths()


def _step(s: int, code: int, t: int) -> tuple[int, str]:
    """Cost and action of taking a turn of role `code` from state s to state t."""
    named = 0 if code == t - 1 else NAME if code == OTHER else RELABEL
    kind = "" if code == t - 1 else "relabel"
    best = (FAR, "")
    if t != START and (s, t) in PATHS:
        best = (named + INSERT * len(PATHS[s, t]), kind or "keep")
    if s == t and s != START:
        best = min(best, (named + MERGE, "relabel+merge" if kind else "merge"))
    return best


STEPS = {(s, code, t): _step(s, code, t) for s in range(STATES) for code in range(OTHER + 1) for t in range(STATES)}
#: For each role the cost matrix of one turn: the transition of the automaton in min-plus algebra.
MATRICES = np.array([[[STEPS[s, code, t][0] for t in range(STATES)] for s in range(STATES)] for code in range(OTHER + 1)], np.int64)
#: Cost of ending in each state.
ENDING = np.array([0, *(0 if r == LAST else INSERT * (1 + len(PATHS[1 + k, 1 + ROLES.index(LAST)])) for k, r in enumerate(ROLES))], np.int64)


def product(codes: list[int]) -> np.ndarray:
    """The cost matrix of a run of turns: the min-plus product of the matrices of its turns."""
    total = np.full((STATES, STATES), FAR, np.int64)
    np.fill_diagonal(total, 0)
    for code in codes:
        total = np.minimum((total[:, :, None] + MATRICES[code][None]).min(axis=1), FAR)
    return total


def trace(codes: list[int], entry: int, leave: int) -> list[int]:
    """The states after each turn of a cheapest way from entry to leave; the smallest states among equals."""
    ahead = np.full(STATES, FAR, np.int64)
    ahead[leave] = 0
    back = [ahead]
    for code in reversed(codes):
        back.append(ahead := np.minimum((MATRICES[code] + ahead[None]).min(axis=1), FAR))
    states, s = [], entry
    for k, code in enumerate(codes):
        s = int((MATRICES[code][s] + back[len(codes) - 1 - k]).argmin())
        states.append(s)
    return states


def role_code(role: Column) -> Column:
    plain = F.lower(F.trim(role))
    code = F.lit(OTHER)
    for k, name in enumerate(ROLES):
        code = F.when(plain == name, k).otherwise(code)
    return F.when(role.isNull(), OTHER).otherwise(code).cast("int")


def _streamed(batches: Iterator[pa.RecordBatch], key: list[str], step: Callable, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Run step over rows sorted by key; its state, none at the first row of a key, is all that is kept."""
    last, state = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (at := tuple(row[c] for c in key)) != last:
                last, state = at, None
            state, made = step(state, row)
            out.append(made)
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct turn, with what the cheapest repair does to it and its piece of the rendering.

    A conversation is legal if its roles follow FOLLOWS and it ends with LAST.  Turns may be merged into the turn
    before, given another role, or preceded (the last one also followed) by inserted empty turns; a dynamic program
    over the automaton of legal turns finds the cheapest way, with the smallest states among equals.  A turn is a
    min-plus matrix, so a conversation of any length is cut into runs that are multiplied apart from each other.  The
    runs are dealt in ranges; of each range one 5 x 5 matrix is scanned in order, forwards for the costs and backwards
    for the states, then the runs within each range, and every run is traced by itself: no task takes a whole
    conversation.

    Columns: conv_id, pos (0 for the first turn), turn, role, action (keep, relabel, merge, relabel+merge),
    new_role, inserted (empty turns put before it), appended (put after the last one), cost, copies, piece.  The
    pieces in the order of pos are the rendered conversation.

    Turns are ordered by turn number, null first, and by a hash of role and text where numbers are equal; rows that
    repeat a turn exactly are one turn (copies tells how many).  Rows without a conversation id form one
    conversation.  Unknown and null roles get a role; a null or empty text is an empty turn, which is repaired like
    any other; a very long text is one turn, carried whole.  The marks OPEN and CLOSE in a text are rendered with a
    backslash after their first character (and a backslash there with another), so that a rendering can be read back.
    Further columns are ignored whatever their names; an empty table gives an empty table."""
    ship(turns.sparkSession)
    conv, turn = F.col(conv_col), F.col(turn_col)
    keyed = turns.select(
        F.coalesce(conv.cast("string"), F.lit("")).alias("conv"),
        F.coalesce(turn.cast("long"), F.lit(-(1 << 62))).alias("turn_no"),
        F.md5(F.concat(F.coalesce(F.col(role_col), F.lit("\x01")), F.lit("\x00"), F.coalesce(F.col(text_col), F.lit("\x01"))).cast("binary")).alias("h"),
        conv.isNull().alias("no_conv"), conv.alias("conv_id"), turn.alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    ).withColumn("conv", F.concat(F.when(F.col("no_conv"), "-").otherwise("+"), "conv"))
    keyed = keyed.withColumn("run", F.floor(F.col("turn_no") / RUN))
    distinct = keyed.select("conv", "run", "turn_no", "h", role_code(F.col("role")).alias("code")).groupBy("conv", "run", "turn_no", "h").agg(F.min("code").alias("code"))
    per_turn = distinct.groupBy("conv", "run", "turn_no").agg(F.count("*").alias("n"))
    crowded = per_turn.groupBy("conv", "run").agg(F.sum("n").alias("total")).where(F.col("total") > MOST).select("conv", "run")
    bits = F.ceil(F.log2(F.greatest(F.col("n") / (MOST // 4), F.lit(1.0)))).cast("int")
    split = per_turn.join(crowded, ["conv", "run"]).select("conv", "turn_no", bits.alias("bits"))
    part = F.when(F.coalesce("bits", F.lit(0)) > 0, F.expr("shiftright(cast(conv(substring(h, 1, 12), 16, 10) as bigint), 48 - bits)")).otherwise(F.lit(0)).cast("long")
    dealt = distinct.join(split, ["conv", "turn_no"], "left").select("conv", "run", F.when(F.col("bits").isNotNull(), F.col("turn_no")).otherwise(0).alias("part_turn"), part.alias("part"), "turn_no", "h", "code")
    chunks = materialise(dealt.groupBy("conv", "run", F.col("part_turn").alias("first_turn"), "part").agg(F.array_sort(F.collect_list(F.struct("turn_no", "h", "code"))).alias("turns")))
    place = ["conv", "run", "first_turn", "part"]
    own = "conv string, run long, first_turn long, part long"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[int(x) for x in c] for c in batch.column(4).to_pylist()]
            made = [product(c).ravel().tolist() for c in rows]
            yield pa.record_batch([*batch.columns[:4], pa.array(list(map(len, rows)), pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=[*place, "n", "m"])

    def scan(rows: DataFrame, key: list[str], order: list[str], bounds: DataFrame | None) -> DataFrame:
        """Entry and leaving states of every row (key and order columns, n, m), with base, the turns before it, and last.

        bounds: for each key the costs before it, the state to leave it in, the turns before it and whether it is the
        conversation's end; none where a key is a whole conversation.  Rows are scanned in order, forwards for the costs
        and backwards for the states; all that is kept is one vector."""
        names = key + [c for c in order if c not in key]
        kinds = [pa.string() if c == "conv" else pa.int64() for c in names]
        own = ", ".join(f"{c} {'string' if c == 'conv' else 'long'}" for c in names)
        outer = rows.withColumns({"e_before": F.lit(None).cast("array<long>"), "e_leave": F.lit(-1), "e_base": F.lit(0).cast("long"), "e_last": F.lit(True)}) if bounds is None else rows.join(bounds, key)

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def step(state: tuple | None, row: dict) -> tuple:
                costs, base = state or (np.array(row["e_before"] or [0, *[FAR] * (STATES - 1)], np.int64), row["e_base"])
                after = np.minimum((costs[:, None] + np.array(row["m"]).reshape(STATES, STATES)).min(axis=0), FAR)
                return (after, base + row["n"]), (*(row[c] for c in names), row["m"], costs.tolist(), after.tolist(), base, row["e_leave"], row["e_last"])

            yield from _streamed(batches, key, step, [*names, "m", "before", "after", "base", "e_leave", "e_last"], [*kinds, *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int32(), pa.bool_()])

        def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def step(leave: int | None, row: dict) -> tuple:
                last = leave is None
                if last:
                    leave = row["e_leave"] if row["e_leave"] >= 0 else int((np.array(row["after"]) + ENDING).argmin())
                entry = int((np.array(row["before"]) + np.array(row["m"]).reshape(STATES, STATES)[:, leave]).argmin())
                return entry, (*(row[c] for c in names), row["before"], entry, leave, last and row["e_last"], row["base"])

            yield from _streamed(batches, key, step, [*names, "before", "entry", "leave", "last", "base"], [*kinds, pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.bool_(), pa.int64()])

        placed = outer.select(*names, "n", "m", "e_before", "e_leave", "e_base", "e_last").repartition(*key).sortWithinPartitions(*key, *order)
        costed = placed.mapInArrow(forward, f"{own}, m array<long>, before array<long>, after array<long>, base long, e_leave int, e_last boolean")
        turned = costed.repartition(*key).sortWithinPartitions(*[F.col(c).desc() for c in [*key, *order]])
        return turned.mapInArrow(backward, f"{own}, before array<long>, entry int, leave int, last boolean, base long")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The products of runs of rows of one conversation and range: one row each, however many rows it has."""
        at, total, n = None, None, 0
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                m = np.array(row["m"], np.int64).reshape(STATES, STATES)
                if at == (row["conv"], row["range"]):
                    total, n = np.minimum((total[:, :, None] + m[None]).min(axis=1), FAR), n + row["n"]
                else:
                    if at is not None:
                        out.append((*at, n, total.ravel().tolist()))
                    at, total, n = (row["conv"], row["range"]), m, row["n"]
            if len(out) > 1000:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "range", "n", "m"])
                out = []
        if at is not None:
            out.append((*at, n, total.ravel().tolist()))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "range", "n", "m"])

    products = chunks.select(*place, F.transform("turns", lambda t: t["code"]).alias("codes")).mapInArrow(multiply, f"{own}, n long, m array<long>")
    # Ranges of rows in order: a conversation of any length is dealt over as many as it fills, and only one matrix of
    # each range of it is scanned in one task.  Written, so that a range is the same rows for all that follows.
    ranged = products.repartitionByRange(*place).withColumn("range", F.spark_partition_id().cast("long"))
    ranged = materialise(ranged)
    sums = ranged.repartition("conv", "range").sortWithinPartitions("conv", "range", *place[1:]).mapInArrow(join_up, "conv string, range long, n long, m array<long>")
    outer = scan(sums, ["conv"], ["range"], None)
    bounds = outer.select("conv", "range", F.col("before").alias("e_before"), F.col("leave").alias("e_leave"), F.col("base").alias("e_base"), F.col("last").alias("e_last"))
    bounds = scan(ranged, ["conv", "range"], place[1:], bounds).select(*place, "entry", "leave", "last", "base")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                s, codes = row["entry"], [t["code"] for t in row["turns"]]
                states = trace(codes, s, row["leave"])
                for k, (t, to) in enumerate(zip(row["turns"], states, strict=True)):
                    cost, action = STEPS[s, t["code"], to]
                    inserted = [] if action.endswith("merge") else [ROLES[x - 1] for x in PATHS[s, to]]
                    end = row["last"] and k + 1 == len(states)
                    appended = [] if not end or ROLES[to - 1] == LAST else [ROLES[x - 1] for x in PATHS[to, 1 + ROLES.index(LAST)]] + [LAST]
                    out.append((row["conv"], t["turn_no"], t["h"], row["base"] + k, action, ROLES[to - 1], inserted, appended, end, cost + INSERT * len(appended)))
                    s = to
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["conv", "turn_no", "h", "pos", "action", "new_role", "inserted", "appended", "last", "cost"])

    joined = chunks.join(bounds, place).select("conv", "turns", "entry", "leave", "last", "base")
    decided = joined.mapInArrow(decide, "conv string, turn_no long, h string, pos long, action string, new_role string, inserted array<string>, appended array<string>, last boolean, cost long")
    whole = keyed.groupBy("conv", "turn_no", "h").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies"))
    full = whole.join(decided, ["conv", "turn_no", "h"])
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(F.lit(OPEN), r, F.lit("\n" + CLOSE))), "")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*\|im_(?:start|end)\|>)", r"<\\$1")
    head = F.concat(F.when(F.col("pos") > 0, CLOSE).otherwise(""), empty(F.col("inserted")), F.lit(OPEN), F.col("new_role"), F.lit("\n"), text)
    body = F.when(F.col("action").endswith("merge"), F.concat(F.lit(JOINT), text)).otherwise(head)
    piece = F.concat(body, F.when(F.col("last"), F.concat(F.lit(CLOSE), empty(F.col("appended")))).otherwise(""))
    return full.select(F.col("conv_id").alias(conv_col), "pos", F.col("turn").alias(turn_col), F.col("role").alias(role_col), "action", "new_role", "inserted", "appended", "cost", "copies", piece.alias("piece"))


def rendered(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, text, cost): whole renderings, for conversations that fit one row."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return repaired.groupBy(conv_col).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("rendered"), F.sum("cost").alias("cost"))
