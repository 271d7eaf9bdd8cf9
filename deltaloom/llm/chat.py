"""Repairs the roles of conversations at least cost, and renders them.

A legal conversation may open with a system turn, goes on with user and assistant in turn, user first, and ends with the
assistant. Each turn may keep its role or be relabelled, open a turn of its own or be merged into the turn before, and
empty turns may be inserted; dynamic programming over the automaton's states finds the cheapest way.

One turn is a matrix of costs from state to state, and a run of turns is the product of theirs in (min, +). So a long
conversation, or one that two partitions share, is cut into pieces: each piece yields its product, a conversation's
products give the states at the cuts, and each piece is then repaired between its two states. All others are repaired
where they lie, each sequence of roles once. Texts stay out of all this and are joined to the repairs at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.text import named
from deltaloom.sources.scratch import Scratch

SYSTEM, USER, ASSISTANT = range(3)
ROLES = ("system", "user", "assistant")
#: The state before the first turn; the states after a turn are its role.
START = 3
#: Roles that stand for one of the three.
SYNONYMS = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "ai": ASSISTANT, "model": ASSISTANT, "developer": SYSTEM}
PIECE_TURNS = 1 << 16


@dataclass(frozen=True)
class Costs:
    """What each repair costs. A turn of no known role may take any for ``unknown``."""

    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 3.0
    unknown: float = 0.5


def role_code(role: str | None) -> int:
    """One of the three roles, or -1."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else SYNONYMS.get(name, -1)


#: Roles to insert on the way from a state to a role; a system turn can only be the first.
_BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (),
    (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (),
    (ASSISTANT, ASSISTANT): (USER,),
}
#: What to insert after the last turn.
_AFTER: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def step(code: int, costs: Costs) -> np.ndarray:
    """The costs of one turn: from state (row) to state (column)."""
    out = np.full((4, 4), np.inf)
    for state in range(4):
        for role in range(3):
            label = 0.0 if code == role else costs.unknown if code < 0 else costs.relabel
            ways = [costs.insert * len(_BETWEEN[state, role])] if (state, role) in _BETWEEN else []
            ways += [costs.merge] if state == role else []
            if ways:
                out[state, role] = label + min(ways)
    return out


def closing(costs: Costs) -> np.ndarray:
    return np.array([costs.insert * len(_AFTER[state]) for state in range(4)])


def product(codes: list[int], costs: Costs) -> np.ndarray:
    """The least costs of a run of turns, from state to state."""
    steps = {code: step(code, costs) for code in set(codes)}
    out = np.full((4, 4), np.inf)
    np.fill_diagonal(out, 0.0)
    for code in codes:
        out = (out[:, :, None] + steps[code][None, :, :]).min(axis=1)
    return out


def cuts(products: list[np.ndarray], costs: Costs) -> list[int]:
    """The states before each piece and after the last, of a cheapest repair; of equal ones the lowest states from the end."""
    reach = [np.array([np.inf, np.inf, np.inf, 0.0])]
    for table in products:
        reach.append((reach[-1][:, None] + table).min(axis=0))
    states = [int(np.argmin(reach[-1] + closing(costs)))]
    for table, before in zip(reversed(products), reversed(reach[:-1]), strict=True):
        states.append(int(np.argmin(before + table[:, states[-1]])))
    return states[::-1]


def roles_between(codes: list[int], first: int, last: int, costs: Costs) -> list[int]:
    """The role of each turn on a cheapest way from state first to state last."""
    reach = [np.where(np.arange(4) == first, 0.0, np.inf)]
    steps = {code: step(code, costs) for code in set(codes)}
    for code in codes:
        reach.append((reach[-1][:, None] + steps[code]).min(axis=0))
    states = [last]
    for code, before in zip(reversed(codes), reversed(reach[:-1]), strict=True):
        states.append(int(np.argmin(before + steps[code][:, states[-1]])))
    return states[::-1][1:]


def repaired(codes: list[int], roles: list[int], first: int, costs: Costs) -> Iterator[tuple[int, int, str]]:
    """(turn, role, action) of what comes out: inserted turns stand before the turn they make legal."""
    state = first
    for k, (code, role) in enumerate(zip(codes, roles, strict=True)):
        between = _BETWEEN.get((state, role))
        if state == role and (between is None or costs.merge <= costs.insert * len(between)):
            yield k, role, "merge"
        else:
            for added in between:
                yield k, added, "insert"
            yield k, role, "keep" if code == role else "relabel"
        state = role


@dataclass(frozen=True)
class _Way:
    """What comes out of a run of turns: per row the turn it is of, its place within that turn, its role and action."""

    turn: np.ndarray
    sub: np.ndarray
    role: np.ndarray
    action: np.ndarray


_ACTIONS = ("keep", "relabel", "merge", "insert")
_INSERT = _ACTIONS.index("insert")


def _way(codes: list[int], first: int, last: int, closes: bool, costs: Costs) -> _Way:
    """Inserted rows take the places 0 to 3 before their turn, the turn place 4, closing rows those from 5."""
    rows, sub = [], 0
    for k, role, action in repaired(codes, roles_between(codes, first, last, costs), first, costs):
        rows.append((k, sub if action == "insert" else 4, role, _ACTIONS.index(action)))
        sub = sub + 1 if action == "insert" else 0
    rows += [(len(codes) - 1, 5 + k, role, _INSERT) for k, role in enumerate(_AFTER[last])] if closes else []
    return _Way(*np.array(rows, dtype=np.int64).reshape(-1, 4).T)


class _Ways:
    """The repairs of whole short conversations, each sequence of roles once. Emptied beyond a bound."""

    def __init__(self, costs: Costs, most: int = 20_000) -> None:
        self.costs, self.most, self.known = costs, most, {}

    def of(self, codes: bytes) -> _Way:
        way = self.known.get(codes)
        if way is None:
            if len(self.known) >= self.most:
                self.known = {}
            listed = np.frombuffer(codes, dtype=np.int8).tolist()
            states = cuts([product(listed, self.costs)], self.costs)
            way = self.known[codes] = _way(listed, states[0], states[1], True, self.costs)
        return way


def opening(role: str) -> str:
    return f"<|{role}|>\n"


_CLOSE = "\n"
_KEYS = ("conv_id", "turn", "role", "tie")
_DONE, _OPEN, _PIECE = range(3)
#: Rows that are settled, turns that are still open, and the costs of each piece of these, in one table.
_STEPS = "kind int, conv_id bigint, turn bigint, role string, tie bigint, piece bigint, place bigint, code int, new_role int, action int, costs array<double>"
_SETTLED = "conv_id bigint, turn bigint, role string, tie bigint, place bigint, new_role int, action int"


def _plain(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return named(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )


def _settle(plain: DataFrame, costs: Costs) -> DataFrame:
    """Sorts turns, without their texts, by range of conversation and turn together, so a conversation of any length is
    spread over partitions, and repairs what lies within one. Open are a partition's first and last conversation, which
    may go on in another, and those of more than PIECE_TURNS."""
    most, schema = PIECE_TURNS, pa.schema([("kind", pa.int32()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.int64()), ("piece", pa.int64()), ("place", pa.int64()), ("code", pa.int32()), ("new_role", pa.int32()), ("action", pa.int32()), ("costs", pa.list_(pa.float64()))])

    def batch_of(n: int, **columns: object) -> pa.RecordBatch:
        arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else pa.array(a, f.type) if not isinstance(a, pa.Array) else a for a, f in zip(arrays, schema, strict=True)]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def codes_of(table: pa.Table) -> np.ndarray:
        roles = table["role"].combine_chunks().dictionary_encode()
        known = np.array([*map(role_code, roles.dictionary.to_pylist()), -1], dtype=np.int8)
        return known[roles.indices.fill_null(-1).to_numpy(zero_copy_only=False)]

    def kept_columns(table: pa.Table) -> dict[str, object]:
        return {name: table[name] for name in _KEYS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ways = _Ways(costs)
        place, begun, rest = TaskContext.get().partitionId() << 40, False, None

        def opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal place
            for k in range(0, len(table), most):
                part = table.slice(k, most)
                n, codes = len(part), codes_of(part)
                yield batch_of(n, kind=[_OPEN] * n, **kept_columns(part), piece=[place] * n, place=place + np.arange(n), code=codes)
                table_of = product(codes.tolist(), costs).ravel().tolist()
                yield batch_of(1, kind=[_PIECE], conv_id=part["conv_id"].slice(0, 1), piece=[place], costs=[table_of])
                place += n

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            conv = now["conv_id"].combine_chunks()
            ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
            if not begun and len(starts) > 1:  # the first conversation may have begun in another partition
                yield from opened(now.slice(0, int(starts[1])))
                now, starts, begun = now.slice(int(starts[1])), starts[1:] - starts[1], True
            whole = int(starts[-1])
            if whole:
                codes, found, offsets = codes_of(now.slice(0, whole)), [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    found.append(ways.of(codes[a:b].tobytes()))
                    offsets.append(a)
                sizes = [len(w.turn) for w in found]
                at = np.concatenate([w.turn for w in found]) + np.repeat(offsets, sizes)
                rows = now.slice(0, whole).take(pa.array(at))
                ordinals = (place + at) * 8 + np.concatenate([w.sub for w in found])
                yield batch_of(len(at), kind=[_DONE] * len(at), **kept_columns(rows), place=ordinals, new_role=np.concatenate([w.role for w in found]), action=np.concatenate([w.action for w in found]))
                place += whole
            rest = now.slice(whole)
            if len(rest) >= most:  # what follows is taken as going on with it
                yield from opened(rest)
                rest, begun = None, False
        if rest is not None and len(rest):
            yield from opened(rest)

    ordered = plain.select(*_KEYS).repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    return ordered.mapInArrow(run, _STEPS)


def _settle_open(steps: DataFrame, costs: Costs) -> DataFrame:
    """The open turns: a conversation's products give the states at its cuts, then each piece is repaired alone."""

    def ends(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        states = cuts([np.array(c).reshape(4, 4) for c in group["costs"]], costs)
        closes = [False] * (len(group) - 1) + [True]
        return pd.DataFrame({"of_piece": group["piece"].to_numpy(), "first": states[:-1], "last": states[1:], "closes": closes})

    def rewrite(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        way = _way(group["code"].tolist(), int(group["first"].iloc[0]), int(group["last"].iloc[0]), bool(group["closes"].iloc[0]), costs)
        out = group.iloc[way.turn][[*_KEYS, "place"]].astype({"conv_id": "Int64", "turn": "Int64"})
        return out.assign(place=out["place"].to_numpy() * 8 + way.sub, new_role=way.role, action=way.action)

    between = steps.where(F.col("kind") == _PIECE).select("conv_id", "piece", "costs").groupBy("conv_id").applyInPandas(ends, "of_piece bigint, first int, last int, closes boolean")
    stated = steps.where(F.col("kind") == _OPEN).select(*_KEYS, "piece", "place", "code").join(between, F.col("piece") == F.col("of_piece"))
    return stated.groupBy("piece").applyInPandas(rewrite, _SETTLED)


def _named(column_: str, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(column_) + 1)


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired turns of conversations (conv_id, turn, role, text): one row per turn given or inserted.

    A conversation in order of ``ordinal`` is legal; joining ``rendered`` in that order gives its text. action is keep,
    relabel, merge (into the turn before) or insert (empty; turn is that of the neighbour it was made for). Turns of
    equal number are ordered by role and a hash of the text. A null role is of no known role, a null text empty, a null
    turn first, and rows without conv_id are one conversation. No turns give no rows. Repeated rows are turns of their
    own; the text of a repeated turn moves once. Texts meet their repairs by conversation, turn, role and hash.
    """
    scratch, plain = Scratch(turns.sparkSession, "chat"), _plain(turns)
    steps = scratch.save(_settle(plain, costs), "steps")
    settled = steps.where(F.col("kind") == _DONE).select(*[c.split()[0] for c in _SETTLED.split(", ")]).unionAll(_settle_open(steps, costs))
    settled = scratch.save(settled, "settled")

    # Keys without nulls, so that one shuffle serves both the distinct texts and the join.
    missing = sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(_KEYS[:3])), F.lit(0))
    keys = [F.coalesce("conv_id", F.lit(0)).alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.coalesce("role", F.lit("")).alias("c"), F.col("tie").alias("d"), missing.alias("e")]
    texts = plain.select(*keys, "text").dropDuplicates(["a", "b", "c", "d", "e"])
    given = settled.where(F.col("action") != _INSERT).select("*", *keys).join(texts, ["a", "b", "c", "d", "e"])
    added = settled.where(F.col("action") == _INSERT).withColumn("role", F.lit(None).cast("string")).withColumn("text", F.lit(""))
    columns = ["conv_id", "turn", "place", "role", "new_role", "action", "text"]
    every = given.select(*columns).unionAll(added.select(*columns))
    start = F.when(F.col("action") == _ACTIONS.index("merge"), "").otherwise(_named("new_role", tuple(map(opening, ROLES))))
    return every.select(
        "conv_id",
        "turn",
        F.col("place").alias("ordinal"),
        F.col("role").alias("old_role"),
        _named("new_role", ROLES).alias("role"),
        _named("action", _ACTIONS).alias("action"),
        "text",
        F.concat(start, "text", F.lit(_CLOSE)).alias("rendered"),
    )


def render(repaired_turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): whole conversations. For conversations that fit a row; longer ones stay as turns."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "rendered")))
    return repaired_turns.groupBy("conv_id").agg(F.concat_ws("", F.transform(listed, lambda x: x["rendered"])).alias("rendered"))
