"""Decides, on names alone, which columns each side keeps and what they are called."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from deltaloom.errors import ConfigError
from deltaloom.spec import DiffConfig, DiffRule, fold_header


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case headers; two that become one are an error."""
    names = [fold_header(c) for c in df.columns]
    refuse_repeats(names, "after header normalisation")
    return df.toDF(*names)


def refuse_repeats(names: list[str], when: str) -> None:
    if twice := [name for name, n in Counter(names).items() if n > 1]:
        raise ConfigError(f"Column names repeat {when}: {', '.join(sorted(twice))}")


def _renames(columns: list[str], rules: list[DiffRule]) -> dict[str, str]:
    return {
        rule.column_names[0]: rule.rename_to
        for rule in rules
        if rule.rename_to and not rule.ignore and len(rule.column_names) == 1 and rule.column_names[0] in columns
    }


def _project(df: DataFrame, dropped: set[str], renames: dict[str, str]) -> DataFrame:
    if clash := dropped & set(renames):
        raise ConfigError(f"Columns both ignored and renamed: {', '.join(sorted(clash))}")
    kept = [(k, c) for k, c in enumerate(df.columns) if c not in dropped]
    names = [renames.get(c, c) for _, c in kept]
    refuse_repeats(names, "after renaming")
    if len(kept) == len(df.columns):
        return df if names == df.columns else df.toDF(*names)
    # By position, so that names that differ only in case stay apart.
    inner = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return inner.select(*[f"c{k}" for k, _ in kept]).toDF(*names)


def align_on_ingest(df: DataFrame, config: DiffConfig, is_source: bool) -> DataFrame:
    """An ignore rule drops what it names or matches on both sides; only the source is renamed."""
    dropped = {c for rule in config.rules if rule.ignore for c in df.columns if rule.selects(c)}
    return _project(df, dropped, _renames(df.columns, config.rules) if is_source else {})


def align_pair(source: DataFrame, target: DataFrame, config: DiffConfig) -> tuple[DataFrame, DataFrame]:
    """As on ingest, but on the target an ignore rule drops only the names it gives, not what its pattern matches."""
    ignoring = [rule for rule in config.rules if rule.ignore]
    from_source = {c for rule in ignoring for c in source.columns if rule.selects(c)}
    named = {name for rule in ignoring for name in ([rule.rename_to] if rule.rename_to else rule.column_names)}
    return (
        _project(source, from_source, _renames(source.columns, config.rules)),
        _project(target, named & set(target.columns), {}),
    )


def check_schemas(source: list[str], target: list[str], config: DiffConfig) -> None:
    """Keys on both sides, and the set relation that the schema mode asks for."""
    left, right, keys = set(source), set(target), set(config.primary_keys)
    for side, names in (("SOURCE", left), ("TARGET", right)):
        if keys - names:
            raise ConfigError(f"Primary keys missing in {side}: {sorted(keys - names)}")
    only_left, only_right = sorted(left - right), sorted(right - left)
    refused = {
        "exact": only_left or only_right,
        "allow_additions": only_left,
        "allow_removals": only_right,
        "intersection": None,
    }[config.schema_mode]
    if refused:
        raise ConfigError(f"Schema mode {config.schema_mode}: only in source {only_left}, only in target {only_right}")
