"""The catalogue of comparison queries over the driver's tables, each with its SQL oracle.

Both sides of each query come from one table; the drift between them is a function of the key, written alike in Spark
SQL and in the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.errors import DeltaloomError
from deltaloom.operators.integrity import duplicate_rows
from deltaloom.plans.diff import DiffEngine
from deltaloom.report import top_drift
from deltaloom.sources.ingest import DataIngestor
from deltaloom.sources.readers import read
from deltaloom.sources.scratch import Scratch
from deltaloom.spec import DiffConfig, DiffRule, DiffSummary, SourceConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_COUNTS = ("added_count", "removed_count", "changed_count", "total_rows_source", "total_rows_target")


def query(oracle: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(source: DataFrame, target: DataFrame, keys: str | list[str], *rules: DiffRule, **settings) -> DiffEngine:
    keys = [keys] if isinstance(keys, str) else keys
    return DiffEngine(DiffConfig(primary_keys=keys, rules=list(rules), **settings), source, target)


def count_sql(source: str, target: str, key: str, equal: str, target_key: str | None = None) -> str:
    """Counts of a comparison; ``equal`` is over ``s`` and ``t`` and never null."""
    return f"""
      WITH s AS (SELECT *, 1 AS here FROM ({source})), t AS (SELECT *, 1 AS here FROM ({target}))
      SELECT count(*) FILTER (WHERE s.here IS NULL) AS added_count, count(*) FILTER (WHERE t.here IS NULL) AS removed_count,
             count(*) FILTER (WHERE s.here = 1 AND t.here = 1 AND NOT ({equal})) AS changed_count,
             (SELECT count({key}) FROM s) AS total_rows_source, (SELECT count({target_key or key}) FROM t) AS total_rows_target
      FROM s FULL JOIN t ON s.{key} = t.{target_key or key}"""


def changed_sql(source: str, target: str, key: str, flags: dict[str, str]) -> str:
    """Key and flags of the rows of both sides where a flag is false."""
    listed = ", ".join(f"{condition} AS {column}_is_match" for column, condition in flags.items())
    return f"""
      SELECT * FROM (SELECT s.{key} AS {key}, {listed} FROM ({source}) s JOIN ({target}) t ON s.{key} = t.{key})
      WHERE NOT ({" AND ".join(f"{column}_is_match" for column in flags)})"""


def changed_flags(e: DiffEngine, *keys: str) -> DataFrame:
    return e.changed().select(*keys, *[f"{c.name}_is_match" for c in e.compared])


# -- sources and alignment ------------------------------------------------------------------------------------------


@query("SELECT 0 AS added_count, 0 AS removed_count, 0 AS changed_count, count(*) AS total_rows_source, count(*) AS total_rows_target FROM nation")
def q01_parquet_roundtrip_diff(spark, sf_dir):
    sides = [SourceConfig(path=f"{sf_dir}/nation.parquet", format="parquet")] * 2
    config = DiffConfig(primary_keys=["n_nationkey"], schema_mode="exact")
    return DiffEngine(config, *DataIngestor(config, *sides, spark).get_dataframes()).counts()


@query("SELECT 0 AS added_count, 0 AS removed_count, 0 AS changed_count, count(*) AS total_rows_source, count(*) AS total_rows_target FROM customer")
def q02_csv_ingest_diff(spark, sf_dir):
    scratch = Scratch(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(scratch.path("customer"))
    config = DiffConfig(primary_keys=["c_custkey"])
    sides = SourceConfig(path=scratch.path("customer"), format="csv"), SourceConfig(path=f"{sf_dir}/customer.parquet", format="parquet")
    return DiffEngine(config, *DataIngestor(config, *sides, spark).get_dataframes()).counts()


_BALANCE = "c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1.0 ELSE 0.0 END"


@query(changed_sql("SELECT * FROM customer", f"SELECT c_custkey, {_BALANCE} AS c_acctbal FROM customer", "c_custkey", {"c_acctbal": "s.c_acctbal = t.c_acctbal"}))
def q03_header_normalize(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    source = customer.toDF(*[f"  {c.upper()} " for c in customer.columns])
    target = customer.selectExpr("c_custkey", f"{_BALANCE} AS c_acctbal")
    config = DiffConfig(primary_keys=["C_CUSTKEY"], normalize_column_names=True)
    ingest = DataIngestor(config, SourceConfig(path="-"), SourceConfig(path="-"), spark)
    return changed_flags(DiffEngine(config, ingest.prepare(source, True), ingest.prepare(target, False)), "c_custkey")


_PRICE = "o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 0.005 ELSE 0.0 END"


@query(
    count_sql(
        "SELECT o_orderkey, o_totalprice FROM orders",
        f"SELECT o_orderkey, {_PRICE} AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0",
        "o_orderkey",
        "s.o_totalprice = t.o_totalprice",
    )
)
def q04_rename_intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    source = orders.selectExpr("o_orderkey AS order_id", "o_totalprice AS price", "o_orderstatus AS only_here")
    target = orders.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey", f"{_PRICE} AS o_totalprice", "o_custkey")
    return engine(
        source,
        target,
        "o_orderkey",
        DiffRule(column_names=["order_id"], rename_to="o_orderkey"),
        DiffRule(column_names=["price"], rename_to="o_totalprice", absolute_tolerance=1.0),  # lost: rules are looked up by the new name
    ).counts()


_LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("""
  WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
  SELECT 0 AS added_count, 0 AS removed_count, count(*) FILTER (WHERE l_orderkey % 13 = 0) AS changed_count,
         count(*) AS total_rows_source, count(*) AS total_rows_target FROM l""")
def q05_ignore_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(*_LINE_KEYS).agg(F.min("l_quantity").alias("l_quantity"), F.max("l_shipdate").alias("l_shipdate"))
    lines = Scratch(spark, "lines").save(lines, "lines")  # both sides, and their keys, are read from it
    target = lines.withColumns({"l_quantity": F.expr("l_quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END"), "l_shipdate": F.lit(None).cast("timestamp_ntz")})
    return engine(lines, target, _LINE_KEYS, DiffRule(pattern="^l_ship.*", ignore=True)).counts()


@query(
    changed_sql(
        "SELECT * FROM customer",
        "SELECT c_custkey, c_nationkey + c_custkey % 3 AS c_nationkey, c_acctbal + c_custkey % 3 AS c_acctbal FROM customer",
        "c_custkey",
        {"c_nationkey": "abs(t.c_nationkey - s.c_nationkey) <= 1.0", "c_acctbal": "s.c_acctbal = t.c_acctbal"},
    )
)
def q06_pattern_rule_precedence(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    target = source.selectExpr("c_custkey", "CAST(c_nationkey + c_custkey % 3 AS int) AS c_nationkey", "c_acctbal + c_custkey % 3 AS c_acctbal")
    rules = DiffRule(pattern="^c_(nation|acct)", absolute_tolerance=1.0), DiffRule(column_names=["c_acctbal"], absolute_tolerance=0.0)
    return changed_flags(engine(source, target, "c_custkey", *rules), "c_custkey")


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1")
def q07_duplicate_keys(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# -- normalisation and match predicates -----------------------------------------------------------------------------

_PADDED = """CASE p_partkey % 4 WHEN 0 THEN concat('  ', p_name) WHEN 1 THEN concat(p_name, chr(9)) WHEN 2 THEN concat(' ', p_name, ' ') ELSE concat(p_name, 'x') END"""


@query("""
  SELECT 'left' AS mode, count(*) FILTER (WHERE p_partkey % 4 <> 0) AS changed_count FROM part
  UNION ALL SELECT 'right', count(*) FILTER (WHERE p_partkey % 4 <> 1) FROM part
  UNION ALL SELECT 'both', count(*) FILTER (WHERE p_partkey % 4 = 3) FROM part
  UNION ALL SELECT 'none', count(*) FROM part""")
def q08_whitespace_modes(spark, sf_dir):
    source = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    target = source.selectExpr("p_partkey", f"{_PADDED} AS p_name")
    out = None
    for mode in ("left", "right", "both", "none"):
        one = engine(source, target, "p_partkey", default_whitespace_mode=mode).counts().select(F.lit(mode).alias("mode"), "changed_count")
        out = one if out is None else out.unionByName(one)
    return out


@query(count_sql("SELECT * FROM customer", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN concat(c_mktsegment, '!') ELSE lower(c_mktsegment) END AS c_mktsegment FROM customer", "c_custkey", "lower(s.c_mktsegment) = lower(t.c_mktsegment)"))
def q09_case_fold(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    target = source.selectExpr("c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN concat(c_mktsegment, '!') ELSE lower(c_mktsegment) END AS c_mktsegment")
    return engine(source, target, "c_custkey", DiffRule(column_names=["c_mktsegment"], case_insensitive=True)).counts()


_STATUS = "CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END"


@query(count_sql("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P') THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders", f"SELECT o_orderkey, CASE WHEN ({_STATUS}) = 'P' THEN NULL ELSE ({_STATUS}) END AS o_orderstatus FROM orders", "o_orderkey", "s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus"))
def q10_null_markers(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    target = source.selectExpr("o_orderkey", f"{_STATUS} AS o_orderstatus")
    return engine(source, target, "o_orderkey", DiffRule(column_names=["o_orderstatus"], null_values=["P"])).counts()


@query(changed_sql("SELECT * FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') || CASE WHEN c_custkey % 8 = 0 THEN '1' ELSE '' END AS c_name FROM customer", "c_custkey", {"c_name": "regexp_replace(s.c_name, '[^0-9]', '', 'g') = t.c_name"}))
def q11_regex_replace(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    target = source.selectExpr("c_custkey", "concat(regexp_replace(c_name, '[^0-9]', ''), CASE WHEN c_custkey % 8 = 0 THEN '1' ELSE '' END) AS c_name")
    return changed_flags(engine(source, target, "c_custkey", DiffRule(column_names=["c_name"], regex_replace={"[^0-9]": ""})), "c_custkey")


@query(count_sql("SELECT o_orderkey, CAST(o_orderkey * 2 AS DOUBLE) AS price FROM orders", "SELECT o_orderkey, o_orderkey * 2 + CASE o_orderkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 ELSE 0.0 END AS price FROM orders", "o_orderkey", "abs(t.price - s.price) <= 0.5"))
def q12_regex_cast_tolerance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    source = orders.selectExpr("o_orderkey", "concat('$', CAST(o_orderkey * 2 AS string)) AS price")
    target = orders.selectExpr("o_orderkey", "CAST(o_orderkey * 2 + CASE o_orderkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 ELSE 0.0 END AS double) AS price")
    rule = DiffRule(column_names=["price"], regex_replace={r"^\$": ""}, cast_to="Float64", absolute_tolerance=0.5)
    return engine(source, target, "o_orderkey", rule).counts()


_FLAG = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END"


@query(count_sql(f"SELECT o_orderkey, {_FLAG} AS o_orderstatus FROM orders", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus ELSE {_FLAG} END AS o_orderstatus FROM orders", "o_orderkey", "s.o_orderstatus = t.o_orderstatus"))
def q13_value_map(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    target = source.selectExpr("o_orderkey", f"CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus ELSE {_FLAG} END AS o_orderstatus")
    return engine(source, target, "o_orderkey", DiffRule(column_names=["o_orderstatus"], value_map={"O": "open", "F": "filled"})).counts()


_SHIFTED = "o_totalprice + CASE o_orderkey % 3 WHEN 0 THEN CAST(0.005 AS double) WHEN 1 THEN CAST(5.0 AS double) ELSE CAST(0.0 AS double) END"


@query(changed_sql("SELECT * FROM orders", f"SELECT o_orderkey, {_SHIFTED} AS o_totalprice FROM orders", "o_orderkey", {"o_totalprice": "abs(t.o_totalprice - s.o_totalprice) <= CAST(0.01 AS DOUBLE)"}))
def q14_absolute_tolerance(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    target = source.selectExpr("o_orderkey", f"{_SHIFTED} AS o_totalprice")
    return changed_flags(engine(source, target, "o_orderkey", default_absolute_tolerance=0.01), "o_orderkey")


_SCALED = "s_acctbal * CASE WHEN s_suppkey % 4 = 0 THEN CAST(1.06 AS double) ELSE CAST(1.005 AS double) END"


@query(changed_sql("SELECT * FROM supplier", f"SELECT s_suppkey, {_SCALED} AS s_acctbal FROM supplier", "s_suppkey", {"s_acctbal": "abs(t.s_acctbal - s.s_acctbal) <= CAST(0.0 AS DOUBLE) + CAST(0.01 AS DOUBLE) * abs(s.s_acctbal)"}))
def q15_relative_tolerance(spark, sf_dir):
    source = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return changed_flags(engine(source, source.selectExpr("s_suppkey", f"{_SCALED} AS s_acctbal"), "s_suppkey", default_relative_tolerance=0.01), "s_suppkey")


_AS_TEXT = "CASE WHEN c_custkey % 10 = 0 THEN 'n/a' WHEN c_custkey % 10 = 1 THEN '99' ELSE CAST(c_nationkey AS {text}) END"


@query(count_sql("SELECT * FROM customer", f"SELECT c_custkey, {_AS_TEXT.format(text='VARCHAR')} AS c_nationkey FROM customer", "c_custkey", "coalesce(s.c_nationkey = TRY_CAST(t.c_nationkey AS INTEGER), FALSE)"))
def q16_soft_cast(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return engine(source, source.selectExpr("c_custkey", f"{_AS_TEXT.format(text='string')} AS c_nationkey"), "c_custkey").counts()


@query("SELECT 0 AS added_count, 0 AS removed_count, count(*) AS changed_count, count(*) AS total_rows_source, count(*) AS total_rows_target FROM customer")
def q17_strict_types(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return engine(source, source.selectExpr("c_custkey", f"{_AS_TEXT.format(text='string')} AS c_nationkey"), "c_custkey", strict_types=True).counts()


_NULLED = "CASE WHEN event_id % {a} = 0 THEN NULL ELSE value END"


def _nulls(spark: SparkSession, sf_dir: str, equal: bool) -> DataFrame:
    events = table(spark, sf_dir, "events")
    source, target = (events.selectExpr("event_id", f"{_NULLED.format(a=a)} AS value") for a in (4, 6))
    return engine(source, target, "event_id", default_treat_null_as_equal=equal).counts()


def _nulls_sql(equal: str) -> str:
    return count_sql(*[f"SELECT event_id, {_NULLED.format(a=a)} AS value FROM events" for a in (4, 6)], "event_id", equal)


@query(_nulls_sql("s.value IS NOT DISTINCT FROM t.value"))
def q18_null_equal(spark, sf_dir):
    return _nulls(spark, sf_dir, True)


@query(_nulls_sql("coalesce(s.value = t.value, FALSE)"))
def q19_null_unequal(spark, sf_dir):
    return _nulls(spark, sf_dir, False)


# -- row classes and aggregates -------------------------------------------------------------------------------------


def _gapped(spark: SparkSession, sf_dir: str) -> DiffEngine:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return engine(orders.where("o_orderkey % 10 <> 1"), orders.where("o_orderkey % 10 <> 2"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 1")
def q20_added(spark, sf_dir):
    return _gapped(spark, sf_dir).added()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 2")
def q21_removed(spark, sf_dir):
    return _gapped(spark, sf_dir).removed()


_TS = "CASE WHEN event_id % 20 = 0 THEN ts + INTERVAL '1' SECOND ELSE ts END"
_TYPE = "CASE WHEN event_id % 30 = 0 THEN upper(event_type) ELSE event_type END"


@query(changed_sql("SELECT * FROM events", f"SELECT event_id, {_TS} AS ts, {_TYPE} AS event_type, value FROM events", "event_id", {"ts": "s.ts = t.ts", "event_type": "s.event_type = t.event_type", "value": "s.value = t.value"}))
def q22_changed(spark, sf_dir):
    source = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    target = source.selectExpr("event_id", f"{_TS} AS ts", f"{_TYPE} AS event_type", "value")
    return changed_flags(engine(source, target, "event_id"), "event_id")


_KEY = "CASE WHEN o_orderkey = {k} THEN NULL ELSE o_orderkey END"
_DRIFTED = "SELECT {key} AS o_orderkey, o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 15 <> 3"
_PLAIN = "SELECT {key} AS o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 15 <> 4"


def _drifted(spark: SparkSession, sf_dir: str, **settings) -> DiffEngine:
    orders = table(spark, sf_dir, "orders")
    source = orders.where("o_orderkey % 15 <> 4").selectExpr(f"{_KEY.format(k=5)} AS o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    target = orders.where("o_orderkey % 15 <> 3").selectExpr(
        f"{_KEY.format(k=7)} AS o_orderkey",
        "o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS o_custkey",
        "CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority",
        "o_totalprice",
    )
    return engine(source, target, "o_orderkey", **settings)


_DRIFT_SIDES = _PLAIN.format(key=_KEY.format(k=5)), _DRIFTED.format(key=_KEY.format(k=7))
_DRIFT_EQUAL = "s.o_custkey = t.o_custkey AND s.o_orderpriority = t.o_orderpriority AND s.o_totalprice = t.o_totalprice"
_DRIFT_COUNTS = count_sql(*_DRIFT_SIDES, "o_orderkey", _DRIFT_EQUAL)
_DRIFT_COLUMNS = f"""
  SELECT * FROM (
    SELECT unnest(['o_custkey', 'o_orderpriority', 'o_totalprice']) AS "column", unnest([a, b, c]) AS mismatches, unnest([0, 1, 2]) AS place FROM (
      SELECT count(*) FILTER (WHERE s.o_custkey <> t.o_custkey) AS a, count(*) FILTER (WHERE s.o_orderpriority <> t.o_orderpriority) AS b,
             count(*) FILTER (WHERE s.o_totalprice <> t.o_totalprice) AS c FROM ({_DRIFT_SIDES[0]}) s JOIN ({_DRIFT_SIDES[1]}) t ON s.o_orderkey = t.o_orderkey)
  ) WHERE mismatches > 0"""


@query(_DRIFT_COUNTS)
def q23_summary_counts(spark, sf_dir):
    return _drifted(spark, sf_dir).counts()


@query(f'SELECT "column", mismatches FROM ({_DRIFT_COLUMNS})')
def q24_column_mismatches(spark, sf_dir):
    return _drifted(spark, sf_dir).column_mismatches().select("column", "mismatches")


def _summary_row(spark: SparkSession, summary: DiffSummary) -> DataFrame:
    names = "total_mismatches", "mismatch_ratio", "match_rate_percentage", "is_match", "is_perfect_match", "volume_shift"
    return spark.createDataFrame(
        [tuple(getattr(summary, name) for name in names)], "total_mismatches bigint, mismatch_ratio double, match_rate_percentage double, is_match boolean, is_perfect_match boolean, volume_shift bigint"
    )


def _summary_sql(counts: str, threshold: float) -> str:
    return f"""
  SELECT *, mismatch_ratio <= CAST({threshold} AS DOUBLE) AS is_match, total_mismatches = 0 AS is_perfect_match, round((1.0 - mismatch_ratio) * 100.0, 2) AS match_rate_percentage FROM (
    SELECT added_count + removed_count + changed_count AS total_mismatches, total_rows_target - total_rows_source AS volume_shift,
           CAST(added_count + removed_count + changed_count AS DOUBLE) / greatest(total_rows_source, 1) AS mismatch_ratio FROM ({counts}))"""


@query(_summary_sql(_DRIFT_COUNTS, 0.5))
def q25_ratio_verdict(spark, sf_dir):
    return _summary_row(spark, _drifted(spark, sf_dir, threshold=0.5).run())


@query(f'SELECT "column", mismatches FROM ({_DRIFT_COLUMNS}) ORDER BY mismatches DESC, place LIMIT 2')
def q26_top_drift(spark, sf_dir):
    summary = _drifted(spark, sf_dir, report_top_columns_limit=2).run()
    return spark.createDataFrame(top_drift(summary.column_mismatches, summary.report_limit), "column string, mismatches bigint")


# -- keys and types -------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role = 'user' AS text_is_match FROM conversations WHERE turn % 2 = 1 AND role <> 'user'")
def q27_composite_key(spark, sf_dir):
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    target = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 2 = 1 AND role <> 'user' THEN concat(text, '.') ELSE text END AS text")
    return changed_flags(engine(source, target, ["conv_id", "turn"]), "conv_id", "turn")


@query("SELECT doc_id, FALSE AS text_is_match FROM documents WHERE doc_id % 17 = 0")
def q28_documents_text_diff(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = source.selectExpr("doc_id", "CASE WHEN doc_id % 17 = 0 THEN concat(text, ' more') WHEN doc_id % 2 = 0 THEN concat('  ', text, chr(10)) ELSE text END AS text")
    return changed_flags(engine(source, target, "doc_id", DiffRule(column_names=["text"], whitespace_mode="both", case_insensitive=True)), "doc_id")


@query("SELECT vec_id, FALSE AS embedding_is_match FROM embeddings WHERE vec_id % 6 = 0")
def q29_array_equality(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    target = source.selectExpr("vec_id", "CASE WHEN vec_id % 6 = 0 THEN reverse(embedding) ELSE embedding END AS embedding")
    return changed_flags(engine(source, target, "vec_id"), "vec_id")


# -- artifacts ------------------------------------------------------------------------------------------------------


def _artifact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Runs a comparison with an output path and reads one artifact back."""
    scratch = Scratch(spark, "artifacts")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    target = customer.where("c_custkey % 10 <> 2").selectExpr("c_custkey", "c_nationkey", f"{_BALANCE} AS c_acctbal")
    engine(customer.where("c_custkey % 10 <> 1"), target, "c_custkey", output_path=scratch.path("out")).run()
    return spark.read.parquet(f"{scratch.path('out')}/{name}_rows.parquet")


@query(f"SELECT c_custkey, c_nationkey, {_BALANCE} AS c_acctbal FROM customer WHERE c_custkey % 10 = 1")
def q30_artifact_added(spark, sf_dir):
    return _artifact(spark, sf_dir, "added")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 10 = 2")
def q31_artifact_removed(spark, sf_dir):
    return _artifact(spark, sf_dir, "removed")


@query(f"""SELECT c_custkey, c_nationkey AS c_nationkey_source, c_acctbal AS c_acctbal_source, c_nationkey AS c_nationkey_target, {_BALANCE} AS c_acctbal_target,
          TRUE AS c_nationkey_is_match, FALSE AS c_acctbal_is_match FROM customer WHERE c_custkey % 10 NOT IN (1, 2) AND c_custkey % 7 = 0""")
def q32_artifact_changed(spark, sf_dir):
    return _artifact(spark, sf_dir, "changed")


@query(f"SELECT c_custkey, c_nationkey AS c_nationkey_source, c_acctbal AS c_acctbal_source, c_acctbal + 1 AS c_acctbal_target, c_nationkey AS c_nationkey_target, TRUE AS c_nationkey_is_match, FALSE AS c_acctbal_is_match FROM customer WHERE c_custkey % 7 = 0")
def q33_artifact_csv(spark, sf_dir):
    scratch = Scratch(spark, "artifacts")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    engine(customer, customer.selectExpr("c_custkey", "c_nationkey", f"{_BALANCE} AS c_acctbal"), "c_custkey", output_path=scratch.path("out"), output_format="csv").run()
    schema = "c_custkey bigint, c_nationkey_source bigint, c_acctbal_source double, c_nationkey_target bigint, c_acctbal_target double, c_nationkey_is_match boolean, c_acctbal_is_match boolean"
    return spark.read.option("header", True).schema(schema).csv(f"{scratch.path('out')}/changed_rows.csv")


# -- what is refused, and verdicts ----------------------------------------------------------------------------------


def _outcome(run: Callable[[], object]) -> str:
    """The name of what a comparison raises, or whether its tables match."""
    try:
        found = run()
    except (DeltaloomError, NotImplementedError) as problem:
        return type(problem).__name__
    return ("match" if found.is_match else "mismatch") if isinstance(found, DiffSummary) else "done"


_SCHEMA_CASES = {
    ("exact", "same"): "match",
    ("exact", "more"): "ConfigError",
    ("exact", "less"): "ConfigError",
    ("allow_additions", "more"): "match",
    ("allow_additions", "less"): "ConfigError",
    ("allow_removals", "more"): "ConfigError",
    ("allow_removals", "less"): "match",
    ("intersection", "more"): "match",
    ("intersection", "less"): "match",
}


def _values_sql(names: str, rows: list[tuple[str, ...]]) -> str:
    listed = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {listed}) AS v({names})"


@query(_values_sql("schema_mode, target, outcome", [(*case, outcome) for case, outcome in _SCHEMA_CASES.items()]))
def q34_schema_modes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    targets = {"same": nation, "more": nation.withColumn("extra", F.lit(1)), "less": nation.drop("n_name")}
    found = [(mode, which, _outcome(engine(nation, targets[which], "n_nationkey", schema_mode=mode).run)) for mode, which in _SCHEMA_CASES]
    return spark.createDataFrame(found, "schema_mode string, target string, outcome string")


_REFUSED = {
    "key missing in target": "ConfigError",
    "key types differ": "ConfigError",
    "keys repeat in source": "DataIntegrityError",
    "headers collide": "ConfigError",
    "names repeat after renaming": "ConfigError",
    "value map of wrong type": "ConfigError",
    "format without reader": "NotImplementedError",
    "format without writer": "NotImplementedError",
    "unknown csv option": "ConfigError",
    "no comparable columns": "match",
}


@query(_values_sql('"case", outcome', list(_REFUSED.items())))
def q35_refusals(spark, sf_dir):
    nation, path = table(spark, sf_dir, "nation"), f"{sf_dir}/nation.parquet"
    folded = DiffConfig(primary_keys=["n_nationkey"], normalize_column_names=True)
    both = nation.select("n_nationkey", F.col("n_name").alias("A"), F.col("n_name").alias(" a"))
    ingest = lambda source: DataIngestor(folded, source, SourceConfig(path=path, format="parquet"), spark)
    shifted = nation.withColumn("n_regionkey", F.col("n_regionkey") + 1)
    cases = {
        "key missing in target": engine(nation, nation.drop("n_nationkey"), "n_nationkey").run,
        "key types differ": engine(nation, nation.withColumn("n_nationkey", F.col("n_nationkey").cast("string")), "n_nationkey").run,
        "keys repeat in source": engine(nation.unionAll(nation), nation, "n_nationkey").run,
        "headers collide": lambda: ingest(SourceConfig(path=path, format="parquet")).prepare(both, True),
        "names repeat after renaming": engine(nation, nation, "n_nationkey", DiffRule(column_names=["n_name"], rename_to="n_regionkey")).run,
        "value map of wrong type": engine(nation, nation, "n_nationkey", DiffRule(column_names=["n_regionkey"], value_map={"1": "1.5"})).run,
        "format without reader": ingest(SourceConfig(path=path, format="avro")).get_dataframes,
        "format without writer": engine(nation, shifted, "n_nationkey", output_path=Scratch(spark, "refused").path("out"), output_format="xml").run,
        "unknown csv option": ingest(SourceConfig(path=path, options={"nope": 1})).get_dataframes,
        "no comparable columns": engine(nation.select("n_nationkey"), nation, "n_nationkey").run,
    }
    return spark.createDataFrame([(name, _outcome(run)) for name, run in cases.items()], '`case` string, outcome string')


_LATE = "o_orderkey, o_totalprice + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS o_totalprice"


@query(" UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, * EXCLUDE (threshold) FROM (SELECT 0 AS threshold, * FROM ({_summary_sql(count_sql('SELECT o_orderkey, o_totalprice FROM orders', f'SELECT {_LATE} FROM orders', 'o_orderkey', 's.o_totalprice = t.o_totalprice'), t)}))" for t in (0.0, 0.05, 0.2)))
def q36_threshold(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    found = [_summary_row(spark, engine(orders, orders.selectExpr(*_LATE.split(", ", 1)), "o_orderkey", threshold=t).run()).withColumn("threshold", F.lit(t)) for t in (0.0, 0.05, 0.2)]
    return found[0].unionByName(found[1]).unionByName(found[2])


_REGION = "CASE n_regionkey WHEN 1 THEN 10 WHEN 2 THEN 1 ELSE n_regionkey END"


@query(count_sql(f"SELECT n_nationkey, {_REGION} AS n_regionkey FROM nation", f"SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey ELSE {_REGION} END AS n_regionkey FROM nation", "n_nationkey", "s.n_regionkey = t.n_regionkey"))
def q37_value_map_on_integers(spark, sf_dir):
    source = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    target = source.selectExpr("n_nationkey", f"CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey ELSE {_REGION} END AS n_regionkey")
    return engine(source, target, "n_nationkey", DiffRule(column_names=["n_regionkey"], value_map={"1": "10", "2": "1"})).counts()


@query(count_sql("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus IN ('O', 'P') THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders", "o_orderkey", "s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus"))
def q38_default_null_markers(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    target = source.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return engine(source, target, "o_orderkey", default_null_values=["O", "P"]).counts()


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def q39_csv_null_markers(spark, sf_dir):
    scratch = Scratch(spark, "csv")
    marked = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 3 = 0 THEN 'n/a' WHEN c_custkey % 5 = 0 THEN '-' ELSE CAST(c_nationkey AS string) END AS c_nationkey",
        "CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE c_mktsegment END AS c_mktsegment",
    )
    marked.write.option("header", True).csv(scratch.path("customer"))
    return read(spark, SourceConfig(path=scratch.path("customer"), options={"null_values": ["n/a", "-"], "multiLine": False}))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a drifted copy: keys dropped and added, prices shifted, priorities re-cased and padded."""
    orders = table(spark, sf_dir, "orders")
    target = orders.where("o_orderkey % 20 <> 0").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", f"{_SHIFTED} AS o_totalprice", "o_orderdate", "concat(lower(o_orderpriority), '  ') AS o_orderpriority"
    )
    rules = DiffRule(column_names=["o_totalprice"], absolute_tolerance=0.01), DiffRule(column_names=["o_orderpriority"], case_insensitive=True, whitespace_mode="both")
    return engine(orders, target, "o_orderkey", *rules).changed()
