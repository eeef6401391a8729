"""Replay of an action log as a prefix scan over composed transitions.

Whether an action counts depends on who owned the draftset at that moment. The log is dealt once by
range of (draftset, seq), so a task walks a stretch of it in order. Whatever draftset begins inside the
stretch is decided at once. Only the stretch's first draftset may have begun before; its actions are
*composed* instead: a state is told by the kinds of action that can change it, its keys, and for
each key the stretch notes when it first occurs and what state that leads to at its end. Such
functions compose associatively, in blocks of bounded size, and give the state in which each stretch
begins; then the actions left open are dealt by stretch and decided in one more pass. So the log
is shuffled twice however long it is, and a task holds at most the distinct actors of a stretch.

States are lists: none (no draftset yet), own and its owner, or sub with the submitter, the user and the
permission it is offered to. A null name equals no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadweave.session import send_package, stage

CREATE, CLAIM = "create", "claim"
SUBMIT_USER, SUBMIT_PERMISSION = "submit_to_user", "submit_to_permission"
SUBMITS = [SUBMIT_USER, SUBMIT_PERMISSION]
#: Stretches composed or walked in one group.
FAN = 256
BEGIN = ("create",)

State = tuple | None
Batches = Iterable[pa.RecordBatch]
FUNCTION = "draftset string, part long, key string, at long, state array<string>"
_FUNCTION = pa.schema([("draftset", pa.string()), ("part", pa.int64()), ("key", pa.string()), ("at", pa.int64()), ("state", pa.list_(pa.string()))])


def keys_of(state: State) -> tuple[str, ...]:
    """What an action must answer to, to change the state."""
    if state is None:
        return BEGIN
    if state[0] == "own":
        return () if state[1] is None else (f"submit|{state[1]}",)
    named = tuple(dict.fromkeys(f"claim|{who}" for who in state[1:3] if who is not None))
    return named if state[3] is None else (*named, f"permission|{state[3]}")


def answers(action: str, actor: str | None, held: list[str] | None) -> tuple[str, ...]:
    """The keys that an action answers to."""
    if action == CREATE:
        return BEGIN
    if actor is None:
        return ()
    if action in SUBMITS:
        return (f"submit|{actor}",)
    return (f"claim|{actor}", *[f"permission|{p}" for p in held or ()]) if action == CLAIM else ()


def after(action: str, actor: str | None, target: str | None, permission: str | None) -> tuple:
    """The state an action leads to if it counts."""
    if action == SUBMIT_USER:
        return ("sub", actor, target, None)
    return ("sub", actor, None, permission) if action == SUBMIT_PERMISSION else ("own", actor)


def decided(state: State, action: str, actor: str | None, target: str | None, permission: str | None, held: list[str] | None) -> tuple[str, State]:
    """An action's outcome and the state after it."""
    counts = any(k in answers(action, actor, held) for k in keys_of(state))
    if counts:
        return "ok", after(action, actor, target, permission)
    if state is None:
        return "not-found", None
    owns = state[0] == "own" and actor is not None and state[1] == actor
    if action == CREATE:
        return "exists", state
    if action == CLAIM:
        return "ok" if owns else "forbidden", state
    return "ok" if owns else "ignored", state


class Composed:
    """What a stretch does to any state, by the keys that occur in it.

    States of the beginning that have come to the same action share one trail; the smaller trail joins
    the larger, and each waits under the keys of its state.
    """

    def __init__(self) -> None:
        self.first: dict[str, int] = {}
        self.trails: dict[int, list[str]] = {}
        self.states: dict[int, tuple] = {}
        self.waiting: dict[str, set[int]] = {}
        self.count = 0

    def _leave(self, trail: int) -> None:
        for key in keys_of(self.states[trail]):
            self.waiting[key].discard(trail)

    def act(self, at: int, keys: tuple[str, ...], state: tuple) -> None:
        """The action at this place, which answers to ``keys`` and leads to ``state``."""
        fresh = [k for k in keys if k not in self.first]
        met = {t for k in keys for t in self.waiting.get(k, ())}
        if not fresh and not met:
            return
        for trail in met:
            self._leave(trail)
        self.first.update(dict.fromkeys(fresh, at))
        trail = max(met, key=lambda t: len(self.trails[t]), default=self.count)
        self.count += trail == self.count
        begun = self.trails.setdefault(trail, [])
        for other in met - {trail}:
            begun.extend(self.trails.pop(other))
            del self.states[other]
        begun.extend(fresh)
        self.states[trail] = state
        for key in keys_of(state):
            self.waiting.setdefault(key, set()).add(trail)

    def entries(self) -> list[tuple[str, int, tuple]]:
        """(key, place of the first action that answers to it, state at the end from there)."""
        return [(key, self.first[key], self.states[t]) for t, keys in self.trails.items() for key in keys]


def applied(state: State, function: dict[str, tuple[int, tuple]]) -> State:
    """The state after a stretch that began in ``state``."""
    found = [function[k] for k in keys_of(state) if k in function]
    return min(found)[1] if found else state


def composed(functions: list[dict[str, tuple[int, tuple]]]) -> dict[str, tuple[int, tuple]]:
    """One function for stretches that follow one another."""
    out: dict[str, tuple[int, tuple]] = {}
    for number, function in enumerate(functions):
        for key, (at, state) in list(out.items()):
            out[key] = (at, applied(state, function))
        for key, (at, state) in function.items():
            out.setdefault(key, ((number << 40) + at, state))
    return out


def _rows(draftset: str | None, part: int, entries: Iterable[tuple[str | None, int, State]]) -> list[tuple]:
    """Rows of a function; one without keys has a row of nulls, so that its place is known."""
    found = [(draftset, part, key, at, None if state is None else list(state)) for key, at, state in entries]
    return found or [(draftset, part, None, 0, None)]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FUNCTION)], schema=_FUNCTION)


def _functions(given: pa.Table) -> list[tuple[int, dict[str, tuple[int, tuple]]]]:
    """The functions of a group by falling place."""
    found: dict[int, dict] = {}
    for r in given.to_pylist():
        mine = found.setdefault(r["part"], {})
        if r["key"] is not None:
            mine[r["key"]] = (r["at"], tuple(r["state"]))
    return sorted(found.items())


def _walked(draftset: str | None, state: State, given: pa.Table) -> pa.Table:
    """The state in which each stretch of a group begins."""
    rows = []
    for part, function in _functions(given):
        rows += _rows(draftset, part, [("begin", 0, state)])
        state = applied(state, function)
    return _table(rows)


def starts(functions: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """``functions`` (:data:`FUNCTION`) to one row per stretch with the ``state`` in which it begins."""
    if parts <= fan:
        return functions.groupBy("draftset").applyInArrow(lambda key, t: _walked(key[0].as_py(), None, t), FUNCTION)
    block = F.floor(F.col("part") / fan)

    def compose(key: tuple, given: pa.Table) -> pa.Table:
        whole = composed([f for _, f in _functions(given)])
        return _table(_rows(key[0].as_py(), key[1].as_py(), [(k, at, s) for k, (at, s) in whole.items()]))

    upper = stage(functions.groupBy("draftset", block.alias("block")).applyInArrow(compose, FUNCTION))
    begun = starts(upper, -(-parts // fan), fan)

    def walk(key: tuple, given: pa.Table, begin: pa.Table) -> pa.Table:
        state = begin["state"][0].as_py()
        return _walked(key[0].as_py(), None if state is None else tuple(state), given)

    left = functions.withColumn("block", block)
    right = begun.withColumn("block", F.col("part"))
    names = [f.name for f in _FUNCTION]
    strip = lambda key, a, b: walk(key, a.select(names), b)
    return left.groupBy("draftset", "block").cogroup(right.groupBy("draftset", "block")).applyInArrow(strip, FUNCTION)


def _walk(schema: pa.Schema):
    """A sorted stretch: its actions decided, but for those of its first draftset, and the functions of its ends."""
    out = pa.schema([*schema, ("outcome", pa.string()), *[f for f in _FUNCTION if f.name != "draftset"]])

    def ends(rows: list[tuple]) -> pa.RecordBatch:
        table = _table(rows)
        columns = [table[f.name].combine_chunks() if f.name in table.column_names else pa.nulls(len(rows), f.type) for f in out]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        part, at, pieces, now, state, function = TaskContext.get().partitionId(), 0, 0, None, None, Composed()
        for batch in batches:
            outcomes = []
            names = ("draftset", "action", "actor", "target", "permission", "_held")
            for draftset, action, actor, target, permission, held in zip(*[batch[c].to_pylist() for c in names]):
                if not pieces or draftset != now:
                    if pieces == 1:
                        yield ends(_rows(now, part, function.entries()))
                    now, state, pieces = draftset, None, pieces + 1
                at += 1
                if pieces == 1:
                    function.act(at, answers(action, actor, held), after(action, actor, target, permission))
                    outcomes.append(None)
                else:
                    outcome, state = decided(state, action, actor, target, permission, held)
                    outcomes.append(outcome)
            known = [*batch.columns, pa.array(outcomes, pa.string()), pa.array([part] * batch.num_rows, pa.int64())]
            rest = [pa.nulls(batch.num_rows, f.type) for f in list(out)[len(known) :]]
            yield pa.RecordBatch.from_arrays([*known, *rest], schema=out)
        if pieces == 1:
            yield ends(_rows(now, part, function.entries()))
        elif pieces:
            yield ends(_rows(now, part, [(BEGIN[0], 0, state)] if state else []))

    return run


def _decide(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Open actions behind the state in which their stretch begins."""
    state = None
    for batch in batches:
        outcomes = []
        names = ("action", "actor", "target", "permission", "_held", "key", "state")
        for action, actor, target, permission, held, key, begun in zip(*[batch[c].to_pylist() for c in names]):
            if key is not None:
                state = None if begun is None else tuple(begun)
                outcomes.append(None)
                continue
            outcome, state = decided(state, action, actor, target, permission, held)
            outcomes.append(outcome)
        place = batch.schema.get_field_index("outcome")
        columns = [pa.array(outcomes, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def outcomes(log: DataFrame, users: DataFrame, fan: int = FAN) -> DataFrame:
    """``log`` with the ``outcome`` of each action; ``users(user, permissions)`` say who may claim what is offered to a permission.

    ``seq`` orders the actions of a draftset and is unique in it; its values may be sparse.
    """
    send_package(log.sparkSession)
    columns = log.columns
    held = users.select(F.col("user").alias("actor"), F.col("permissions").alias("_held"))
    claims = log.filter(F.col("action") == CLAIM).join(held, "actor", "left").select(*columns, "_held")
    others = log.filter(F.coalesce(F.col("action") != CLAIM, F.lit(True))).withColumn("_held", F.lit(None).cast("array<string>"))
    dealt = claims.unionByName(others).repartitionByRange("draftset", "seq").sortWithinPartitions("draftset", "seq")
    schema = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema.fields]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    walked = stage(dealt.mapInArrow(_walk(schema), f"{fields}, outcome string, part long, key string, at long, state array<string>"))
    functions = walked.filter("at is not null").select("draftset", "part", "key", "at", "state")
    parts = walked.agg(F.max("part").alias("last")).first().last
    begun = starts(functions, (parts or 0) + 1, fan)
    open_ = walked.filter("at is null and outcome is null")
    # A stretch's last draftset may not be its first: only where the first is open is there anything to decide.
    first = open_.select("part", "draftset").distinct().withColumnsRenamed({"part": "_part", "draftset": "_draftset"})
    same = (F.col("part") == F.col("_part")) & F.col("draftset").eqNullSafe(F.col("_draftset"))
    heads = begun.join(first, same, "left_semi")
    rows = open_.unionByName(heads, allowMissingColumns=True)
    ordered = rows.repartition("part").sortWithinPartitions("part", F.col("key").isNull(), "seq")
    decided_ = ordered.mapInArrow(_decide, rows.schema).filter("key is null")
    return walked.filter("outcome is not null").unionByName(decided_).select(*columns, "outcome")
