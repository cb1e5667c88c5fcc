"""Operator 3: chat formatting after a minimum-cost repair of roles.

Legal conversations are words of a small automaton: an optional system turn, then user and assistant in turn, with an
assistant at the end.  Each turn is given a role: its own, or another (``RELABEL``; ``UNKNOWN`` where it has none of the three).  Between
two turns of one role the second is merged into the first (``MERGE``), and missing turns are inserted empty (``INSERT`` each).
Dynamic programming finds the cheapest repair; among equals the one that prefers states in the order of ``STATES``.

A conversation of any length is cut into segments of at most ``SEGMENT`` turns.  Each segment is reduced to a matrix of the
costs between the states before and after it.  Neighbouring matrices, at most ``FAN``, are reduced to one, and these again, until a
conversation has one matrix.  The states at its borders are passed down the same way, group by group, and then segments are solved by
themselves.  So no task ever holds more than ``SEGMENT`` turns or ``FAN`` matrices of a conversation, however long it is.  Among
equal repairs the borders of larger groups are decided first.

The result has one row for each turn; the ``rendered`` pieces of a conversation, in the order of ``part`` and ``idx``, are the
formatted chat.  Turns are ordered by ``turn`` (null first), then by role and text; repeated rows stay turns of their own.  A
null ``conv_id`` is a conversation like any other; a null role is unknown, a null text empty.  Roles are compared without case
and surrounding blanks.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import common

STATES = ("begin", "system", "user", "assistant")
MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
SEGMENT, FAN = 1024, 256
#: Legal next states; a conversation ends after an assistant.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
END = 3
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _inserted(a: int, b: int) -> tuple[int, ...] | None:
    """Shortest list of roles to insert so that ``b`` may follow ``a``; a system turn is never made up."""
    if b in NEXT[a]:
        return ()
    for x in NEXT[a]:
        if x != 1 and b in NEXT[x]:
            return (x,)
    for x in NEXT[a]:
        for y in NEXT[x]:
            if 1 not in (x, y) and b in NEXT[y]:
                return (x, y)
    return None


#: For each pair of states: cost of the step apart from a relabel, whether it merges, what it inserts.
STEP: dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]] = {}
for _a in range(4):
    for _b in range(1, 4):
        if _a == _b:
            STEP[_a, _b] = (MERGE, True, ())
        elif (_between := _inserted(_a, _b)) is not None:
            STEP[_a, _b] = (INSERT * len(_between), False, _between)
#: Cost to end in each state.
FINISH = [0 if s in (0, END) else INSERT * (1 + len(_inserted(s, END) or ())) for s in range(4)]


def step_costs(role: int) -> np.ndarray:
    """Costs of a turn of this role (0: unknown) from each state to each state."""
    out = np.full((4, 4), FAR)
    for (a, b), (cost, _, _) in STEP.items():
        out[a, b] = cost + (0 if b == role else UNKNOWN if role == 0 else RELABEL)
    return out


COSTS = np.stack([step_costs(r) for r in range(4)])


def matrix(roles: list[int]) -> np.ndarray:
    """Cheapest costs from each state before the turns to each state after them."""
    total = np.full((4, 4), FAR)
    np.fill_diagonal(total, 0)
    for r in roles:
        total = np.minimum((total[:, :, None] + COSTS[r][None]).min(axis=1), FAR)
    return total


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Cheapest costs over neighbouring stretches."""
    total = matrices[0]
    for m in matrices[1:]:
        total = np.minimum((total[:, :, None] + m[None]).min(axis=1), FAR)
    return total


def borders(matrices: list[np.ndarray], state: int = 0, stop: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """States before and after each stretch from ``state`` on, and the cost; up to the state ``stop``, or to the conversation's end."""
    to_go = [np.array(FINISH, np.int64)]
    if stop is not None:
        to_go = [np.where(np.arange(4) == stop, 0, FAR)]
    for m in reversed(matrices):
        to_go.append((m + to_go[-1][None]).min(axis=1))
    to_go.reverse()
    first, out = state, []
    for m, after in zip(matrices, to_go[1:], strict=True):
        end = int(np.argmin(m[state] + after))
        out.append((state, end))
        state = end
    return out, int(to_go[0][first])


def solve(roles: list[int], start: int, end: int) -> list[int]:
    """States after each turn of the cheapest way from ``start`` to ``end``."""
    to_go = np.full((len(roles) + 1, 4), FAR)
    to_go[-1, end] = 0
    for i in range(len(roles) - 1, -1, -1):
        to_go[i] = np.minimum((COSTS[roles[i]] + to_go[i + 1][None]).min(axis=1), FAR)
    out, state = [], start
    for i, r in enumerate(roles):
        state = int(np.argmin(COSTS[r][state] + to_go[i + 1]))
        out.append(state)
    return out


def _matrices(batch: pa.RecordBatch) -> list[pa.Array]:
    return [pa.array([matrix(r).ravel().tolist() for r in batch.column("roles").to_pylist()], pa.list_(pa.int64()))]


def _products(batch: pa.RecordBatch) -> list[pa.Array]:
    return [pa.array([product([np.array(s["m"]).reshape(4, 4) for s in inside]).ravel().tolist() for inside in batch.column("inside").to_pylist()], pa.list_(pa.int64()))]


def _borders(batch: pa.RecordBatch) -> list[pa.Array]:
    rows = batch.to_pydict()
    ends, costs = [], []
    for inside, start, stop, end, cost in zip(rows["inside"], rows["start"], rows["stop"], rows["last"], rows["cost"], strict=True):
        found, total = borders([np.array(s["m"]).reshape(4, 4) for s in inside], start, stop)
        last = len(found) - 1
        ends.append([{"part": s["part"], "seg": s["seg"], "start": a, "stop": b, "last": end and i == last} for i, (s, (a, b)) in enumerate(zip(inside, found, strict=True))])
        costs.append(total if cost is None else cost)
    return [pa.array(ends, _ENDS_PA), pa.array(costs, pa.int64())]


_ENDS_PA = pa.list_(pa.struct([("part", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("last", pa.bool_())]))
_ENDS = "array<struct<part: bigint, seg: bigint, start: int, stop: int, last: boolean>>"


def _solved(batch: pa.RecordBatch) -> list[pa.Array]:
    rows = batch.to_pydict()
    before, after = [], []
    for roles, start, stop in zip(rows["roles"], rows["start"], rows["stop"], strict=True):
        states = solve(roles, start, stop)
        before.append([start, *states[:-1]])
        after.append(states)
    return [pa.array(before, pa.list_(pa.int32())), pa.array(after, pa.list_(pa.int32()))]


def _ends(segments: DataFrame) -> DataFrame:
    """conv_id, part, seg, start, stop, last and cost of all segments; every group has at most ``FAN`` members."""
    parts, segs = segments.agg(F.max("part"), F.max("seg")).first()
    parts, segs = (parts or 0) + 1, (segs or 0) + 1
    levels, lower = [], segments.select("conv_id", "part", "seg", "m")
    while not levels or parts * segs > 1:
        # Parts and segments in order; all at once when they are few, else segments of a part first.
        by_part, by_seg = (FAN, FAN) if parts * segs <= FAN else (1, FAN) if segs > 1 else (FAN, 1)
        upper = lower.groupBy("conv_id", F.floor(F.col("part") / by_part).alias("up_part"), F.floor(F.col("seg") / by_seg).alias("up_seg"))
        upper = upper.agg(F.sort_array(F.collect_list(F.struct("part", "seg", "m"))).alias("inside"))
        upper = upper.withColumnsRenamed({"up_part": "part", "up_seg": "seg"})
        upper = common.stored(upper.mapInArrow(common.by_batch(_products, ["m"]), common.extend(upper.schema, ("m", T.ArrayType(T.LongType())))), "groups")
        levels.append(upper)
        lower, parts, segs = upper.drop("inside"), -(-parts // by_part), -(-segs // by_seg)
    known = None
    for groups in reversed(levels):
        if known is None:
            none = F.lit(None)
            rows = groups.select("conv_id", "inside", F.lit(0).alias("start"), none.cast("int").alias("stop"), F.lit(True).alias("last"), none.cast("long").alias("cost"))
        else:
            same = groups["conv_id"].eqNullSafe(known["conv_id"]) & (groups["part"] == known["part"]) & (groups["seg"] == known["seg"])
            rows = groups.join(known, same).select(groups["conv_id"], "inside", "start", "stop", "last", "cost")
        solved = T.StructType([rows.schema["conv_id"], T.StructField("ends", T._parse_datatype_string(_ENDS)), T.StructField("cost", T.LongType())])
        rows = rows.mapInArrow(common.by_batch(_borders, ["ends", "cost"], ("inside", "start", "stop", "last", "cost")), solved)
        known = rows.select("conv_id", "cost", F.inline("ends"))
    return known


def repair(turns: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, part, idx, role_in, role, action, inserted, cost of the conversation, rendered."""
    common.prepared(turns.sparkSession)
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    code = F.when(role == "system", 1).when(role == "user", 2).when(role == "assistant", 3).otherwise(0)
    rows = turns.select("conv_id", "turn", F.col("role").alias("role_in"), code.alias("code"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role_in", F.xxhash64("text"), "salt"]
    rows = rows.withColumn("salt", common.salt()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    rows = common.numbered(rows, "turns").withColumn("seg", (F.col("idx") / SEGMENT).cast("long"))
    # Neighbours of one conversation in one stretch of a part: at most SEGMENT roles.
    segments = rows.groupBy("conv_id", "part", "seg").agg(F.sort_array(F.collect_list(F.struct("idx", "code"))).alias("c"))
    segments = segments.select("conv_id", "part", "seg", F.transform("c", lambda x: x["code"]).alias("roles"))
    segments = common.stored(
        segments.mapInArrow(common.by_batch(_matrices, ["m"]), common.extend(segments.schema, ("m", T.ArrayType(T.LongType())))), "segments"
    )
    ends = _ends(segments)
    same = segments["conv_id"].eqNullSafe(ends["conv_id"]) & (segments["part"] == ends["part"]) & (segments["seg"] == ends["seg"])
    solved = segments.join(ends, same).select(segments["conv_id"], segments["part"], segments["seg"], "roles", "cost", "start", "stop", "last")
    solved = solved.mapInArrow(common.by_batch(_solved, ["before", "after"]), common.extend(
        solved.schema, ("before", T.ArrayType(T.IntegerType())), ("after", T.ArrayType(T.IntegerType()))))
    # The first place of a segment is that of its first row; places follow without gaps.
    firsts = rows.groupBy("conv_id", "part", "seg").agg(F.min("idx").alias("first"))
    same = solved["conv_id"].eqNullSafe(firsts["conv_id"]) & (solved["part"] == firsts["part"]) & (solved["seg"] == firsts["seg"])
    solved = solved.join(firsts, same).select(solved["part"].alias("p"), "first", "cost", "stop", "last",
        F.posexplode(F.arrays_zip("before", "after")).alias("k", "s"), F.size("after").alias("n"), "after")
    placed = solved.select(
        "p", (F.col("first") + F.col("k")).alias("i"), "cost", F.col("s.before").alias("a"), F.col("s.after").alias("b"),
        (F.col("last") & (F.col("k") == F.col("n") - 1)).alias("closing"),
    )
    out = rows.join(placed, (rows["part"] == F.col("p")) & (rows["idx"] == F.col("i")))
    return _rendered(out)


def _rendered(rows: DataFrame) -> DataFrame:
    """Text of each turn; a turn that is merged continues the turn before, so each turn closes the one before it."""
    empty = {s: OPEN.format(STATES[s]) + CLOSE for s in range(1, 4)}
    between, lead = F.lit(0), F.lit("")
    for (a, b), (_, merges, inserted) in STEP.items():
        here = (F.col("a") == a) & (F.col("b") == b)
        text = "\n" if merges else ("" if a == 0 else CLOSE) + "".join(empty[s] for s in inserted) + OPEN.format(STATES[b])
        lead = F.when(here, F.lit(text)).otherwise(lead)
        between = F.when(here, F.lit(len(inserted))).otherwise(between)
    tail, after = F.lit(""), F.lit(0)
    for s in range(1, 4):
        more = () if s == END else (*(_inserted(s, END) or ()), END)
        here = F.col("closing") & (F.col("b") == s)
        tail = F.when(here, F.lit(CLOSE + "".join(empty[x] for x in more))).otherwise(tail)
        after = F.when(here, F.lit(len(more))).otherwise(after)
    names = F.array(*[F.lit(s) for s in STATES])
    role = F.element_at(names, F.col("b") + 1)
    action = F.concat_ws("+", F.when(F.col("b") != F.col("code"), F.lit("relabel")), F.when(F.col("a") == F.col("b"), F.lit("merge")))
    return rows.select(
        "conv_id", "turn", "part", "idx", "role_in", role.alias("role"),
        F.when(action == "", F.lit("keep")).otherwise(action).alias("action"), (between + after).cast("int").alias("inserted"),
        F.col("cost").alias("conversation_cost"), F.concat(lead, "text", tail).alias("rendered"),
    )
