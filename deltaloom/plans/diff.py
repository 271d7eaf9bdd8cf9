"""The comparison as one plan.

Both sides are normalised in one projection each, joined once by a full outer join on the keys, and reduced to a
single aggregate row. Only that row and one row of key counts reach the driver; rows that differ are written by the
executors. Inside the plan columns have positional names, so headers with dots, quotes or mere differences in case
need no care; the names come back on output.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.errors import DataIntegrityError
from deltaloom.functions.match import check_value_map, matches
from deltaloom.functions.normalize import normalize
from deltaloom.operators.align import align_pair, check_schemas, refuse_repeats
from deltaloom.operators.integrity import check_key_types, key_profile
from deltaloom.sources.sinks import write_artifact
from deltaloom.spec import ColumnRule, DiffConfig, DiffSummary, resolve

_BOTH, _SOURCE, _TARGET, _SPREAD = "_both", "_in_source", "_in_target", "_spread"


def _spread_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a join key that is 0 but where a key is null: such rows never meet another, and need not meet in one task."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.withColumn(_SPREAD, F.when(null, F.xxhash64(*hashed)).otherwise(F.lit(0).cast("bigint")))


@dataclass(frozen=True)
class Side:
    """One side: the raw frame under positional names, and per column its name, normalised expression and type."""

    raw: DataFrame
    names: list[str]
    columns: list[Column]
    types: list[T.DataType]

    def key_columns(self, keys: list[str]) -> list[int]:
        return [self.names.index(k) for k in keys]


@dataclass(frozen=True)
class Compared:
    """A column that is compared: its name, its place on either side and its rule."""

    name: str
    source: int
    target: int
    rule: ColumnRule


class DiffEngine:
    """Compares two DataFrames. It changes neither its inputs nor the session's settings, and can run again."""

    def __init__(self, config: DiffConfig, source_df: DataFrame, target_df: DataFrame) -> None:
        self.config, self.source_df, self.target_df = config, source_df, target_df

    # -- plan ---------------------------------------------------------------------------------------------------

    @cached_property
    def _sides(self) -> tuple[Side, Side]:
        source, target = align_pair(self.source_df, self.target_df, self.config)
        check_schemas(source.columns, target.columns, self.config)
        shared = set(source.columns)
        sides = self._side(source, "s", shared), self._side(target, "t", shared)
        keys = self.config.primary_keys
        check_key_types(keys, *[[side.types[k] for k in side.key_columns(keys)] for side in sides])
        return sides

    def _side(self, df: DataFrame, prefix: str, shared: set[str]) -> Side:
        raw = df.toDF(*[f"{prefix}{k}" for k in range(len(df.columns))])
        columns, types = [], []
        for k, (name, f) in enumerate(zip(df.columns, df.schema, strict=True)):
            rule = resolve(self.config, name) if name in shared else ColumnRule()
            c, dtype = normalize(F.col(f"{prefix}{k}"), f.dataType, rule, name)
            columns.append(c)
            types.append(dtype)
        return Side(raw, df.columns, columns, types)

    @cached_property
    def compared(self) -> list[Compared]:
        """In the source's order: columns of both sides that are no keys and that no rule ignores."""
        source, target = self._sides
        found = []
        for k, name in enumerate(source.names):
            if name in self.config.primary_keys or name not in target.names:
                continue
            rule = resolve(self.config, name)
            if not rule.ignore:
                check_value_map(name, source.types[k], rule.value_map or {})
                found.append(Compared(name, k, target.names.index(name), rule))
        return found

    def _flag(self, c: Compared) -> Column:
        source, target = self._sides
        return matches(F.col(f"s{c.source}"), F.col(f"t{c.target}"), source.types[c.source], target.types[c.target], c.rule, self.config.strict_types)

    def _frame(self, side: Side, prefix: str, marker: str, only: set[int] | None = None) -> DataFrame:
        """Keys as k0.., other columns under their positional names, and a marker that is true."""
        keys = side.key_columns(self.config.primary_keys)
        rest = [k for k in range(len(side.names)) if k not in keys and (only is None or k in only)]
        return side.raw.select(
            *[side.columns[k].alias(f"k{n}") for n, k in enumerate(keys)],
            *[side.columns[k].alias(f"{prefix}{k}") for k in rest],
            F.lit(True).alias(marker),
        )

    def _joined(self, every_column: bool) -> DataFrame:
        """The full outer join; without every_column it carries only what the predicates read."""
        source, target = self._sides
        left = self._frame(source, "s", _SOURCE, None if every_column else {c.source for c in self.compared})
        right = self._frame(target, "t", _TARGET, None if every_column else {c.target for c in self.compared})
        both = F.col(_SOURCE).isNotNull() & F.col(_TARGET).isNotNull()
        flags = {f"m{n}": self._flag(c) for n, c in enumerate(self.compared)}
        keys = [f"k{n}" for n in range(len(self.config.primary_keys))]
        joined = _spread_nulls(left, keys).join(_spread_nulls(right, keys), [*keys, _SPREAD], "full_outer").drop(_SPREAD)
        return joined.withColumns({_BOTH: both, **flags}) if flags else joined.withColumn(_BOTH, both)

    def _changed(self) -> Column:
        flags = [F.col(f"m{n}") for n in range(len(self.compared))]
        return F.col(_BOTH) & ~reduce(lambda a, b: a & b, flags) if flags else F.lit(False)

    def _tallies(self, joined: DataFrame) -> DataFrame:
        return joined.agg(
            F.count_if(F.col(_SOURCE).isNull()).alias("added_count"),
            F.count_if(F.col(_TARGET).isNull()).alias("removed_count"),
            F.count_if(self._changed()).alias("changed_count"),
            *[F.count_if(F.col(_BOTH) & ~F.col(f"m{n}")).alias(f"m{n}") for n in range(len(self.compared))],
        )

    # -- lazy results -------------------------------------------------------------------------------------------

    def profiles(self) -> DataFrame:
        """``side, duplicates, total`` for source and target, in one job."""
        out = None
        for name, side in zip(("SOURCE", "TARGET"), self._sides, strict=True):
            keys = side.key_columns(self.config.primary_keys)
            prefix = side.raw.columns[0][0]
            one = key_profile(side.raw, [F.col(f"{prefix}{k}") for k in keys], side.columns[keys[0]]).select(F.lit(name).alias("side"), "duplicates", "total")
            out = one if out is None else out.unionByName(one)
        return out

    def added(self) -> DataFrame:
        """Target rows without a source row of the same key."""
        return self._unmatched(*reversed(self._sides))

    def removed(self) -> DataFrame:
        """Source rows without a target row of the same key."""
        return self._unmatched(*self._sides)

    def _unmatched(self, side: Side, other: Side) -> DataFrame:
        keys = self.config.primary_keys
        mine, theirs = side.key_columns(keys), other.key_columns(keys)
        left = side.raw.select(*[c.alias(f"x{k}") for k, c in enumerate(side.columns)])
        right = other.raw.select(*[other.columns[k].alias(f"y{n}") for n, k in enumerate(theirs)])
        same = reduce(lambda a, b: a & b, [F.col(f"x{k}") == F.col(f"y{n}") for n, k in enumerate(mine)])
        return left.join(right, same, "left_anti").toDF(*side.names)

    def changed(self) -> DataFrame:
        """Keys, every other column of either side, and a match flag per compared column, where a flag is false."""
        source, target = self._sides
        keys = self.config.primary_keys
        left, right = self._frame(source, "s", _SOURCE).drop(_SOURCE), self._frame(target, "t", _TARGET).drop(_TARGET)
        joined = left.join(right, [f"k{n}" for n in range(len(keys))], "inner").withColumn(_BOTH, F.lit(True))
        return self._changed_rows(joined.withColumns({f"m{n}": self._flag(c) for n, c in enumerate(self.compared)}) if self.compared else joined)

    def _changed_rows(self, joined: DataFrame) -> DataFrame:
        source, target = self._sides
        keys = self.config.primary_keys
        picked = [(f"k{n}", key) for n, key in enumerate(keys)]
        picked += [(f"s{k}", f"{name}_source") for k, name in enumerate(source.names) if name not in keys]
        picked += [(f"t{k}", f"{name}_target") for k, name in enumerate(target.names) if name not in keys]
        picked += [(f"m{n}", f"{c.name}_is_match") for n, c in enumerate(self.compared)]
        refuse_repeats([name for _, name in picked], "in the changed rows")
        return joined.where(self._changed()).select(*[inner for inner, _ in picked]).toDF(*[name for _, name in picked])

    def counts(self) -> DataFrame:
        """One row: the three counts and both totals."""
        names = ["added_count", "removed_count", "changed_count"]
        tallies = self._tallies(self._joined(False)).select(*names, F.lit(0).alias("total_rows_source"), F.lit(0).alias("total_rows_target"))
        totals = self.profiles().select(
            *[F.lit(0).alias(name) for name in names],
            *[F.when(F.col("side") == side.upper(), F.col("total")).otherwise(0).alias(f"total_rows_{side}") for side in ("source", "target")],
        )
        every = [*names, "total_rows_source", "total_rows_target"]
        return tallies.unionByName(totals).agg(*[F.sum(name).cast("bigint").alias(name) for name in every])

    def column_mismatches(self) -> DataFrame:
        """``column, position, mismatches`` of the columns that have any."""
        tallies = self._tallies(self._joined(False))
        each = [
            F.struct(F.lit(c.name).alias("column"), F.lit(n).alias("position"), F.col(f"m{n}").alias("mismatches"))
            for n, c in enumerate(self.compared)
        ]
        if not each:
            return tallies.sparkSession.createDataFrame([], "column string, position int, mismatches bigint")
        return tallies.select(F.inline(F.array(*each))).where("mismatches > 0")

    # -- run ----------------------------------------------------------------------------------------------------

    def check_uniqueness(self) -> dict[str, int]:
        """Totals by side; raises if a side has rows that share a key."""
        found = {row["side"]: row for row in self.profiles().collect()}  # two rows
        for side in ("SOURCE", "TARGET"):
            if n := found[side]["duplicates"]:
                raise DataIntegrityError(f"Primary keys {self.config.primary_keys} are not unique in {side}: {n} duplicate rows")
        return {side: row["total"] for side, row in found.items()}

    def run(self) -> DiffSummary:
        """Two jobs: the key counts, then the joined aggregate. With an output path also the writes."""
        refuse_repeats(self._changed_names(), "in the changed rows")
        totals = self.check_uniqueness()
        keep = self.config.output_path is not None
        joined = self._joined(keep)
        if keep:
            joined = joined.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            row = self._tallies(joined).collect()[0]  # one row
            counts = {name: row[name] for name in ("added_count", "removed_count", "changed_count")}
            if keep:
                self._export(joined, counts)
        finally:
            if keep:
                joined.unpersist()
        ratio = sum(counts.values()) / max(totals["SOURCE"], 1)
        return DiffSummary(
            total_rows_source=totals["SOURCE"],
            total_rows_target=totals["TARGET"],
            **counts,
            column_mismatches={c.name: row[f"m{n}"] for n, c in enumerate(self.compared) if row[f"m{n}"]},
            is_match=ratio <= self.config.threshold,
            report_limit=self.config.report_top_columns_limit,
        )

    def _changed_names(self) -> list[str]:
        source, target = self._sides
        keys = self.config.primary_keys
        return [*keys, *(f"{c}_source" for c in source.names if c not in keys), *(f"{c}_target" for c in target.names if c not in keys)]

    def _export(self, joined: DataFrame, counts: dict[str, int]) -> None:
        frames = {
            "added": self._one_side(joined, self._sides[1], "t", F.col(_SOURCE).isNull()),
            "removed": self._one_side(joined, self._sides[0], "s", F.col(_TARGET).isNull()),
            "changed": self._changed_rows(joined) if counts["changed_count"] else None,
        }
        for name, frame in frames.items():
            write_artifact(frame, counts[f"{name}_count"], self.config.output_path, f"{name}_rows", self.config.output_format)

    def _one_side(self, joined: DataFrame, side: Side, prefix: str, where: Column) -> DataFrame:
        keys = side.key_columns(self.config.primary_keys)
        inner = [f"k{keys.index(k)}" if k in keys else f"{prefix}{k}" for k in range(len(side.names))]
        return joined.where(where).select(*inner).toDF(*side.names)
