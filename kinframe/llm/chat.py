"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant messages in turn, the last
one the assistant's: a walk through the automaton START, SYSTEM, USER, ASSISTANT. Each turn is kept,
relabelled (``RELABEL`` for a known role, ``UNKNOWN`` for any other), merged into the message before it
(``MERGE``) or put after an empty message that is inserted (``INSERT`` each, at the end too). Dynamic
programming over the states finds the cheapest repair; of equally cheap ones, that which comes from the
lesser state, looking back from the end.

Turns are ordered by (turn, role, hash of the text) and laid out in ranges of (conversation, order). What
a range does to a conversation that goes beyond it is a 4 x 4 matrix of costs, and matrices compose, so
one conversation with a third of all turns is still solved range by range: only the conversations that a
range shares with its neighbours (at most 2 a range) are put together by the driver. Texts move once,
when the decisions join them.

Each turn is rendered as a piece; the pieces of a conversation, in order, are its rendering, so that no
row has to hold a conversation of any length.

Defined cases: roles are trimmed and lower-cased, a null role is unknown, a null text renders as empty;
null conversation ids are one conversation and null turns come first; repeated rows are turns of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinframe.llm.common import stored, whole_text

MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40

OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _message(role: str, text: str = "") -> str:
    return OPEN.format(role) + text + CLOSE


def _step(s: int, t: int) -> tuple[int, str, tuple[str, ...]] | None:
    """(cost, action, roles inserted first) of a turn that ends as state ``t`` after state ``s``."""
    if t == START:
        return None
    if s == t:
        return MERGE, "merge", ()
    if t == SYSTEM:
        return (0, "new", ()) if s == START else None
    if t == USER:
        return 0, "new", ()
    return (0, "new", ()) if s == USER else (INSERT, "new", ("user",))


#: COST[kind][s][t] for turns of role 0 .. 2, or 3 for any other.
COST = np.full((4, 4, 4), NEVER, np.int64)
for _s in range(4):
    for _t in range(1, 4):
        if _step(_s, _t):
            for _k in range(4):
                COST[_k, _s, _t] = _step(_s, _t)[0] + (UNKNOWN if _k == 3 else RELABEL * (_k != _t - 1))
#: What it costs to end, and the empty messages that are then put last.
END = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}
END_COST = np.array([INSERT * len(END[s]) for s in range(4)], np.int64)
ENTRY = np.array([0, NEVER, NEVER, NEVER], np.int64)


def _forward(kinds: bytes, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost of each state after the turns, state before it: a row per turn)."""
    back = np.empty((len(kinds), 4), np.int8)
    for n, k in enumerate(kinds):
        cost = entry[:, None] + COST[k]
        back[n] = cost.argmin(axis=0)
        entry = np.minimum(cost.min(axis=0), NEVER)
    return entry, back


def _walk(back: np.ndarray, last: int) -> list[int]:
    """The state before the turns, then that after each, for the walk that ends in ``last``."""
    states = [last]
    for row in back[::-1].tolist():
        states.append(row[states[-1]])
    return states[::-1]


@lru_cache(maxsize=100_000)
def solve(kinds: bytes) -> tuple[int, ...]:
    """States of a whole conversation, before its first turn and after each."""
    cost, back = _forward(kinds, ENTRY)
    return tuple(_walk(back, int((cost + END_COST).argmin())))


def matrix(kinds: bytes) -> np.ndarray:
    """Least cost from each state (row) to each state over some turns."""
    return np.stack([_forward(kinds, np.where(np.arange(4) == s, 0, NEVER))[0] for s in range(4)])


def _layout(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns ``conv, turn, role, digest, n, kind`` with ``part`` and ``place``: ranges of the order."""
    spark = turns.sparkSession
    name = F.lower(F.trim(F.col("role")))
    kind = F.when(name == ROLES[0], 0).when(name == ROLES[1], 1).when(name == ROLES[2], 2).otherwise(3)
    keyed = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
                         F.xxhash64(F.col(text)).alias("digest"))
    order = ["conv", "turn", "role", "digest"]
    distinct = keyed.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    ranged = distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    row = F.monotonically_increasing_id()
    return stored(ranged.sortWithinPartitions(*order).select("*", kind.cast("int").alias("kind"), row.alias("row")).select(
        *order, "n", "kind", F.shiftright("row", 33).cast("int").alias("part"), "row"), "turns")


def _conversations(table: pa.Table):
    """(conversation, first row, end, kinds of its turns, copies counted) of a sorted range."""
    conv = table.column("conv").to_pylist()
    kind, copies = table.column("kind").to_pylist(), table.column("n").to_pylist()
    begin = 0
    for k in range(1, len(conv) + 1):
        if k == len(conv) or conv[k] != conv[begin]:
            kinds = b"".join(bytes([a]) * n for a, n in zip(kind[begin:k], copies[begin:k]))
            yield conv[begin], begin, k, kinds
            begin = k


def _edges(table: pa.Table) -> pa.Table:
    """The first and the last conversation of a range: turns and matrix."""
    table = table.sort_by("row")
    own = list(_conversations(table))
    part = table.column("part")[0].as_py()
    out = [(part, n, len(kinds), matrix(kinds).ravel().tolist())
           for n, (_, _, _, kinds) in enumerate(own) if n in (0, len(own) - 1)]
    conv = pa.array([own[n][0] for _, n, _, _ in out], table.schema.field("conv").type)
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] == len(own) - 1 for x in out]),
                     pa.array([len(own) == 1 for _ in out]), conv, pa.array([x[2] for x in out], pa.int64()),
                     pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                    names=["part", "last", "only", "conv", "turns", "costs"])


def _maps(entries: dict):
    """Per range and shared conversation: the state before it, and the messages begun, for each state after it."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        part = table.column("part")[0].as_py()
        out = []
        for conv, _, _, kinds in _conversations(table):
            if (part, conv) in entries:
                _, back = _forward(kinds, np.array(entries[part, conv], np.int64))
                walks = [_walk(back, t) for t in range(4)]
                out.append((conv, [w[0] for w in walks], [_begun(w) for w in walks]))
        return pa.table([pa.array([part] * len(out), pa.int32()), pa.array([x[0] for x in out], table.schema.field("conv").type),
                         pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                        names=["part", "conv", "before", "begun"])

    return run


def _begun(states) -> int:
    """Messages that a walk begins, inserted ones counted."""
    return sum(1 + len(step[2]) for s, t in zip(states, states[1:]) if (step := _step(s, t)) and step[1] == "new")


def _decided(shared: dict):
    """Decisions for every distinct turn of a range, as lists over its copies."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        part = table.column("part")[0].as_py()
        copies = table.column("n").to_pylist()
        place, state, before, message, last = [], [], [], [], []
        for conv, begin, end, kinds in _conversations(table):
            turns, messages, is_end = 0, 0, True
            if (part, conv) in shared:
                entry, final, turns, messages, is_end = shared[part, conv]
                _, back = _forward(kinds, np.array(entry, np.int64))
                states = _walk(back, final)
            else:
                states = solve(kinds)
            k = 0
            for n in copies[begin:end]:
                place.append(turns + k)
                state.append(list(states[k + 1:k + 1 + n]))
                before.append(states[k])
                numbers = []
                for s, t in zip(states[k:k + n], states[k + 1:k + 1 + n]):
                    _, action, inserted = _step(s, t)
                    messages += (1 + len(inserted)) * (action == "new")
                    numbers.append(messages - 1)
                message.append(numbers)
                k += n
                last.append(is_end and k == len(kinds))
        keys = ["conv", "turn", "role", "digest", "n"]
        columns = [table.column(c) for c in keys]
        more = [pa.array(place, pa.int64()), pa.array(state, pa.list_(pa.int32())), pa.array(before, pa.int32()),
                pa.array(message, pa.list_(pa.int64())), pa.array(last, pa.bool_())]
        return pa.table(columns + more, names=keys + ["place", "states", "before", "messages", "last"])

    return run


def _shared(layout: DataFrame) -> dict:
    """(range, conversation) -> (entry costs, state after it, turns and messages before it, ends there) of the
    conversations that lie in several ranges: at most two rows a range come to the driver."""
    conv_type = layout.schema["conv"].dataType.simpleString()
    rows = layout.groupBy("part").applyInArrow(
        _edges, f"part int, last boolean, only boolean, conv {conv_type}, turns long, costs array<long>").collect()
    chains: dict = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["last"])):
        chains.setdefault(r["conv"], []).append(r)
    chains = {c: own for c, own in chains.items() if len(own) > 1}
    entries = {}
    ends = {}
    for conv, own in chains.items():
        cost = ENTRY
        for r in own:
            entries[r["part"], conv] = cost.tolist()
            cost = np.minimum((cost[:, None] + np.array(r["costs"]).reshape(4, 4)).min(axis=0), NEVER)
        ends[conv] = int((cost + END_COST).argmin())
    if not entries:
        return {}
    parts = sorted({p for p, _ in entries})
    maps = {(r["part"], r["conv"]): r for r in layout.filter(F.col("part").isin(parts)).groupBy("part").applyInArrow(
        _maps(entries), f"part int, conv {conv_type}, before array<int>, begun array<long>").collect()}
    out = {}
    for conv, own in chains.items():
        state, finals, begun = ends[conv], {}, {}
        for r in reversed(own):
            at = r["part"], conv
            finals[r["part"]], begun[r["part"]] = state, maps[at]["begun"][state]
            state = maps[at]["before"][state]
        turns = messages = 0
        for r in own:
            out[r["part"], conv] = (entries[r["part"], conv], finals[r["part"]], turns, messages, r is own[-1])
            turns, messages = turns + r["turns"], messages + begun[r["part"]]
    return out


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_col, place`` (in the conversation, from 0), ``turn_col, role_col, new_role,
    action`` (``keep, relabel, merge, relabel+merge``), ``inserted`` (empty messages put before or, after the
    last turn, behind it), ``message`` (number of the repaired message) and ``piece`` (rendered text)."""
    layout = _layout(turns, conv_col, turn_col, role_col, text_col)
    conv_type, turn_type = (layout.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    plans = layout.groupBy("part").applyInArrow(
        _decided(_shared(layout)),
        f"conv {conv_type}, turn {turn_type}, role string, digest long, n long, place long, states array<int>, "
        "before int, messages array<long>, last boolean")
    plans = plans.select(*[F.col(c).alias(f"p_{c}") for c in plans.columns])
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.xxhash64(F.col(text_col)).alias("digest"),
                        whole_text(text_col).alias("text"))
    keys = ["conv", "turn", "role", "digest"]
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    copy = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0))) - 1
    joined = rows.join(plans, same).withColumn("k", copy)
    joined = joined.select(
        "*", F.get("p_states", F.col("k")).alias("state"), F.get("p_messages", F.col("k")).alias("message"),
        F.when(F.col("k") == 0, F.col("p_before")).otherwise(F.get("p_states", F.col("k") - 1)).alias("was"),
        (F.col("p_last") & (F.col("k") == F.col("p_n") - 1)).alias("ends"))
    new_role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("state") - 1)
    merged = F.col("was") == F.col("state")
    inserted = F.lit(0)
    head, tail = F.lit(""), F.lit("")
    for s in range(4):
        for t in range(1, 4):
            step = _step(s, t)
            if step and step[2]:
                here = (F.col("was") == s) & (F.col("state") == t)
                inserted = F.when(here, len(step[2])).otherwise(inserted)
                head = F.when(here, "".join(map(_message, step[2]))).otherwise(head)
        if END[s]:
            here = F.col("ends") & (F.col("state") == s)
            tail = F.when(here, "".join(map(_message, END[s]))).otherwise(tail)
            inserted = inserted + F.when(here, len(END[s])).otherwise(0)
    piece = F.concat(
        F.when(merged, "\n").otherwise(F.concat(
            F.when(F.col("was") == START, "").otherwise(CLOSE), head, F.format_string(OPEN.replace("{}", "%s"), new_role))),
        "text", F.when(F.col("ends"), CLOSE).otherwise(""), tail)
    known = F.coalesce(F.lower(F.trim(F.col("role"))), F.lit(""))
    action = F.concat_ws("+", F.when(known != new_role, "relabel"), F.when(merged, "merge"))
    return joined.select(
        F.col("conv").alias(conv_col), (F.col("p_place") + F.col("k")).alias("place"), F.col("turn").alias(turn_col),
        F.col("role").alias(role_col), new_role.alias("new_role"),
        F.when(action == "", "keep").otherwise(action).alias("action"), inserted.cast("int").alias("inserted"),
        "message", piece.alias("piece"))
