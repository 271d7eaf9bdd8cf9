"""Scenarios on inline frames with results worked out by hand."""

import pytest
from pydantic import ValidationError

from deltaloom import DataIngestor, DiffConfig, DiffEngine, DiffRule, DiffSummary, SourceConfig, load_config
from deltaloom.cli import main
from deltaloom.errors import ConfigError, DataIntegrityError
from deltaloom.functions.dialect import java_pattern, java_replacement
from deltaloom.report import render
from deltaloom.sources.readers import reader_for
from deltaloom.spec import resolve


def compare(spark, left, right, schema, *rules, target_schema=None, keys=("id",), **settings):
    source, target = spark.createDataFrame(left, schema), spark.createDataFrame(right, target_schema or schema)
    return DiffEngine(DiffConfig(primary_keys=list(keys), rules=list(rules), **settings), source, target)


def counts(engine):
    s = engine.run()
    return s.added_count, s.removed_count, s.changed_count


def test_row_classes_totals_and_columns(spark):
    e = compare(spark, [(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "x"), (4, "d")], "id long, val string")
    s = e.run()
    assert (s.added_count, s.removed_count, s.changed_count, s.column_mismatches) == (1, 1, 1, {"val": 1})
    assert not s.is_match and s.mismatch_ratio == 1.0 and s.volume_shift == 0
    assert [r.id for r in e.added().collect()] == [4] and [r.id for r in e.removed().collect()] == [3]
    assert e.changed().columns == ["id", "val_source", "val_target", "val_is_match"]
    assert counts(e) == (1, 1, 1)  # a second run is the same


def test_rules_resolve_to_one_winner():
    config = DiffConfig(
        primary_keys=["id"], default_absolute_tolerance=9, rules=[DiffRule(pattern="^a", absolute_tolerance=1), DiffRule(column_names=["ab"], absolute_tolerance=0.0)]
    )
    assert [resolve(config, c).abs_tol for c in ("ab", "ac", "b")] == [0.0, 1, 9]


def test_rename_loses_the_rules_own_settings(spark):
    source = spark.createDataFrame([(1, 10.0)], "k long, v double")
    target = spark.createDataFrame([(1, 10.5)], "id long, w double")
    rules = [DiffRule(column_names=["k"], rename_to="id"), DiffRule(column_names=["v"], rename_to="w", absolute_tolerance=1)]
    assert DiffEngine(DiffConfig(primary_keys=["id"], rules=rules), source, target).run().changed_count == 1


@pytest.mark.parametrize(
    ("rule", "left", "right", "changed"),
    [
        ({"whitespace_mode": "both"}, "  a\t", "a", 0),
        ({"whitespace_mode": "left"}, "a ", "a", 1),
        ({"case_insensitive": True}, "ABC", "abc", 0),
        ({"regex_replace": {"[^0-9]": ""}}, "$1,0", "10", 0),
        ({"value_map": {"M": "Male"}}, "M", "Male", 0),
        ({"null_values": ["N/A"]}, "N/A", None, 0),
        ({"null_values": ["N/A"], "treat_null_as_equal": False}, "N/A", None, 1),
        ({}, None, None, 0),
        ({}, None, "x", 1),
    ],
)
def test_string_rules(spark, rule, left, right, changed):
    e = compare(spark, [(1, left)], [(1, right)], "id long, v string", DiffRule(column_names=["v"], **rule))
    assert counts(e) == (0, 0, changed)


def test_tolerances_nan_and_infinity(spark):
    inf, nan = float("inf"), float("nan")
    left = [(1, 100.0), (2, 100.0), (3, nan), (4, inf), (5, 10.44)]
    right = [(1, 105.0), (2, 106.0), (3, 1.0), (4, inf), (5, 10.45)]
    assert counts(compare(spark, left, right, "id long, v double", default_relative_tolerance=0.05)) == (0, 0, 2)  # 2 and 4
    assert counts(compare(spark, left[4:], right[4:], "id long, v double", default_absolute_tolerance=0.01)) == (0, 0, 0)


def test_types_soft_strict_and_hard_cast(spark):
    args = (spark, [(1, 10.0), (2, None)], [(1, "10"), (2, "junk")], "id long, v double")
    assert counts(compare(*args, target_schema="id long, v string")) == (0, 0, 0)  # uncastable meets null: both null
    assert counts(compare(*args, target_schema="id long, v string", strict_types=True)) == (0, 0, 2)
    rule = DiffRule(column_names=["v"], cast_to="Int64")
    with pytest.raises(Exception, match="cannot cast"):
        compare(spark, [(1, "x")], [(1, "1")], "id long, v string", rule).run()


def test_null_keys_never_meet_and_duplicates_raise(spark):
    s = compare(spark, [(None, "a"), (1, "b")], [(None, "a"), (1, "b")], "id long, v string").run()
    assert (s.added_count, s.removed_count, s.total_rows_source) == (1, 1, 1)
    with pytest.raises(DataIntegrityError, match="SOURCE: 2 duplicate"):
        compare(spark, [(1, "a"), (1, "b")], [(1, "a")], "id long, v string").run()


@pytest.mark.parametrize(
    ("mode", "left", "right", "fails"),
    [("exact", "id long", "id long, x long", True), ("allow_additions", "id long", "id long, x long", False), ("allow_additions", "id long, x long", "id long", True),
     ("allow_removals", "id long, x long", "id long", False), ("allow_removals", "id long", "id long, x long", True), ("intersection", "id long, a long", "id long, b long", False)],
)
def test_schema_modes(spark, mode, left, right, fails):
    e = DiffEngine(DiffConfig(primary_keys=["id"], schema_mode=mode), spark.createDataFrame([], left), spark.createDataFrame([], right))
    if fails:
        with pytest.raises(ConfigError):
            e.run()
    else:
        assert e.run().is_match


def test_names_with_dots_and_case(spark):
    e = compare(spark, [(1, "a", "b")], [(1, "a", "c")], "id long, `x.y` string, `X` string")
    assert e.run().column_mismatches == {"X": 1}


def test_key_types_must_agree(spark):
    with pytest.raises(ConfigError):
        compare(spark, [(1,)], [("1",)], "id long", target_schema="id string").run()


def test_artifacts(spark, tmp_path):
    out = str(tmp_path / "out")
    compare(spark, [(1, "a"), (2, "b")], [(2, "x"), (3, "c")], "id long, v string", output_path=out).run()
    assert [spark.read.parquet(f"{out}/{n}_rows.parquet").count() for n in ("added", "removed", "changed")] == [1, 1, 1]
    with pytest.raises(NotImplementedError):
        compare(spark, [(1, "a")], [(1, "b")], "id long, v string", output_path=out, output_format="xml").run()


def test_yaml_csv_and_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text('ID ,Val\n1,"a ""q"" b"\n2,\n')
    (tmp_path / "t.csv").write_text('id,val\n1,"a ""q"" b"\n2,""\n')
    path = tmp_path / "c.yaml"
    path.write_text(f"source: {{path: {tmp_path}/s.csv}}\ntarget: {{path: {tmp_path}/t.csv}}\nprimary_keys: [id]\nnormalize_column_names: true\n")
    config, source, target = load_config(path)
    left, right = DataIngestor(config, source, target, spark).get_dataframes()
    assert left.dtypes[0] == ("id", "bigint")
    assert DiffEngine(config, left, right).run().changed_count == 1  # null against the empty string
    with pytest.raises(SystemExit) as end:
        main(["run", "-c", str(tmp_path / "none.yaml")])
    assert end.value.code == 1 and "can't be set up" in capsys.readouterr().err


def run_cli(path):
    with pytest.raises(SystemExit) as end:
        main(["run", "-c", str(path)])
    return end.value.code


def test_cli_from_files_to_artifacts(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text("id,name,price\n1,a,1.5\n2,b,2.5\n3,c,3.5\n")
    (tmp_path / "t.csv").write_text("id,name,price\n1,A,1.5\n2,b,2.6\n4,d,4.5\n")
    sides = f"source: {{path: {tmp_path}/s.csv}}\ntarget: {{path: {tmp_path}/%s.csv}}\nprimary_keys: [id]\noutput_path: {tmp_path}/out\n"
    (tmp_path / "same.yaml").write_text(sides % "s")
    assert run_cli(tmp_path / "same.yaml") == 0
    said = capsys.readouterr().out
    assert "PASSED (Perfect Match)" in said and str(tmp_path / "out") not in said and not (tmp_path / "out").exists()
    (tmp_path / "other.yaml").write_text(sides % "t" + "rules:\n  - {column_names: [name], case_insensitive: true}\n  - {column_names: [price], absolute_tolerance: 0.01}\n")
    assert run_cli(tmp_path / "other.yaml") == 1
    said = capsys.readouterr().out
    assert "FAILED" in said and "price: 1 mismatches" in said and str(tmp_path / "out") in said
    assert [[r.id for r in spark.read.parquet(f"{tmp_path}/out/{n}_rows.parquet").collect()] for n in ("added", "removed", "changed")] == [[4], [3], [2]]
    (tmp_path / "mild.yaml").write_text((tmp_path / "other.yaml").read_text() + "threshold: 1.0\n")
    assert run_cli(tmp_path / "mild.yaml") == 0
    (tmp_path / "broken.yaml").write_text(sides % "nowhere")
    assert run_cli(tmp_path / "broken.yaml") == 1 and "broke off" in capsys.readouterr().err


def test_csv_artifacts(spark, tmp_path):
    out = str(tmp_path / "out")
    compare(spark, [(1, "a"), (2, 'b "x", y')], [(2, "x"), (3, None)], "id long, v string", output_path=out, output_format="csv").run()
    found = {n: [tuple(r) for r in spark.read.option("header", True).option("escape", "\\").csv(f"{out}/{n}_rows.csv").collect()] for n in ("added", "removed", "changed")}
    assert found == {"added": [("3", None)], "removed": [("1", "a")], "changed": [("2", 'b "x", y', "x", "false")]}


def test_csv_null_markers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,x,b,s,none\n1,-,n/a,true,a,-\n2,5,1.5,-,-,n/a\n")
    found = reader_for("csv")(spark, str(tmp_path / "a.csv"), {"null_values": ["-", "n/a"]})
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in found.collect()] == [(1, None, None, True, "a", None), (2, 5, 1.5, None, None, None)]


@pytest.mark.parametrize(("kind", "good", "bad"), [("long", {"1": "-2"}, {"1": "1.5"}), ("byte", {"1": "127"}, {"1": "128"}), ("double", {"1": "1.5"}, {"a": "1"}), ("decimal(4,1)", {"1": "100.5"}, {"1": "0.25"}), ("boolean", None, {"1": "0"})])
def test_value_map_entries_are_values_of_the_column(spark, kind, good, bad):
    if good:
        assert counts(compare(spark, [], [], f"id long, v {kind}", DiffRule(column_names=["v"], value_map=good))) == (0, 0, 0)
    with pytest.raises(ConfigError, match="value_map"):
        compare(spark, [], [], f"id long, v {kind}", DiffRule(column_names=["v"], value_map=bad)).run()


def test_null_keys_are_spread(spark):
    """Rows with a null key never meet, and are not sent to one task for it."""
    rows = [(None, None, k) for k in range(400)] + [(1, None, 7), (1, 1, 8)]
    e = compare(spark, rows[:1], rows[:1], "a long, b long, v long", keys=("a", "b"))
    assert counts(e) == (1, 1, 0)
    frames = [spark.createDataFrame(rows, "a long, b long, v long").repartition(4) for _ in range(2)]
    joined = DiffEngine(DiffConfig(primary_keys=["a", "b"]), *frames)._joined(False)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = joined.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(sizes) == 2 * 401 + 1 and max(sizes) < 400


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from deltaloom.sources.scratch import shared_folder

    class Session:
        def __init__(self, **settings):
            self.conf = {k.replace("_", "."): v for k, v in settings.items()}

    assert shared_folder(Session(spark_checkpoint_dir="s3a://x/y/", spark_master="yarn")) == "s3a://x/y"
    assert shared_folder(Session(spark_master="local[4]")).startswith("file:")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ConfigError):
            shared_folder(Session(spark_master=master))


def test_scratch_tables_are_freed_with_what_they_shuffled(spark, tmp_path):
    from pathlib import Path

    from deltaloom.sources.scratch import Scratch, freed_after

    kept = Scratch(spark, "kept")
    with freed_after():
        inner = Scratch(spark, "inner")
        found = kept.save(inner.save(spark.range(1000).repartition(4, "id"), "a").groupBy().count(), "b")
        assert Path(inner.root.removeprefix("file://")).exists()
    assert not Path(inner.root.removeprefix("file://")).exists() and found.collect()[0][0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_sample_is_cached_read_again_and_replaced_if_corrupt(spark, tmp_path, monkeypatch):
    from deltaloom import datasets

    monkeypatch.setattr(datasets, "cache_folder", lambda: tmp_path / "cache")
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "made"))
    url = next((tmp_path / "made").glob("*.parquet")).as_uri()
    assert datasets.load_nyc_taxi(spark, url).count() == 5
    assert datasets.load_nyc_taxi(spark, "file:///nowhere").count() == 5  # from the cache
    (tmp_path / "cache" / "nyc_taxi.parquet").write_bytes(b"no parquet file")
    (tmp_path / "cache" / ".nyc_taxi.parquet.crc").unlink(missing_ok=True)
    assert datasets.load_nyc_taxi(spark, url).count() == 5
    (tmp_path / "cache" / "nyc_taxi.parquet").unlink()
    with pytest.raises(RuntimeError):
        datasets.load_nyc_taxi(spark, "file:///nowhere")
    assert not list((tmp_path / "cache").glob("nyc*"))


def test_configuration_errors(tmp_path):
    for text in ("a: [", "- 1", "source: {path: a}", "source: {path: a}\ntarget: {path: b}\nprimary_keys: [id]\nunknown: 1"):
        (tmp_path / "x.yaml").write_text(text)
        with pytest.raises(ConfigError):
            load_config(tmp_path / "x.yaml")
    for bad in ({"pattern": "("}, {"regex_replace": {"(": ""}}, {"absolute_tolerance": -1}, {"whitespace_mode": "up"}, {"nope": 1}):
        with pytest.raises(ValidationError):
            DiffRule(**bad)
    with pytest.raises(NotImplementedError):
        reader_for("delta")
    with pytest.raises(ValidationError):
        SourceConfig(path="a", format="nope")


def test_report():
    s = DiffSummary(total_rows_source=10, total_rows_target=20, added_count=1, removed_count=0, changed_count=1, column_mismatches={"a": 1, "b": 5}, is_match=False, report_limit=1)
    assert s.match_rate_percentage == 80.0 and "FAILED" in render(s) and "b: 5" in render(s) and "a: 1" not in render(s)
    assert "report_limit" not in s.model_dump()


def test_dialect():
    assert java_pattern("(?P<n>a)$") == r"(?Ud)(?<n>a)\z"
    assert java_replacement("$1 ${n} $$ \\") == "$1 ${n} \\$ \\\\"
