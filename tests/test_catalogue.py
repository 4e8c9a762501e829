"""Every registered query of the engine against its SQL, run by DuckDB."""

from pathlib import Path

import duckdb
import pytest

from keylode.plans import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    if name not in catalogue.ORACLES:
        assert len(found)
        return
    db = duckdb.connect()
    for p in SF.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = db.execute(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    a, b = (d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (found, want))
    assert a.equals(b)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_positions_do_not_depend_on_partitions(spark, parts):
    from keylode.operators.scan import positions

    rows = spark.range(500).selectExpr("id * 7 % 501 as k").repartition(parts)
    found = {r["k"]: r["pos"] for r in positions(rows, "k").collect()}
    assert found == {k: i + 1 for i, k in enumerate(sorted(found))}


@pytest.mark.parametrize("kind", ["long", "binary", "string"])
@pytest.mark.parametrize("count", [0, 1, 400])
def test_floor_keys(spark, kind, count):
    from keylode.operators.scan import floor_keys

    as_kind = f"cast({'cast(lpad(id, 5, 0) as string)' if kind != 'long' else 'id'} as {kind})"
    held = spark.range(count).selectExpr("id * 37 % 1009 as id").selectExpr(f"{as_kind} as k").union(spark.sql(f"select cast(null as {kind}) as k"))
    asked = spark.range(1100).union(spark.range(5, 8)).selectExpr(f"{as_kind} as p", "id as n").union(spark.sql(f"select cast(null as {kind}) as p, -1L as n"))
    found = sorted(((r["n"], r["floor"]) for r in floor_keys(asked, held, "p", "k").collect()), key=lambda x: x[0])
    plain = sorted(i * 37 % 1009 for i in range(count))
    own = (lambda x: x) if kind == "long" else (lambda x: f"{x:05d}") if kind == "string" else (lambda x: bytearray(f"{x:05d}".encode()))
    want = [(-1, None)]
    for n in sorted([*range(1100), 5, 6, 7]):
        below = [x for x in plain if x <= n]
        want.append((n, own(below[-1]) if below else None))
    assert found == want


def test_rows_are_kept_or_refused_by_their_key(spark):
    from keylode.errors import MAX_KEY
    from keylode.operators.scan import refused_keys, valid_keys

    rows = spark.createDataFrame([(0, "a"), (1, ""), (2, None), (3, "é" * (MAX_KEY // 2 + 1)), (4, "x" * MAX_KEY)], "n int, k string")
    assert sorted(r["n"] for r in valid_keys(rows, "k").collect()) == [0, 4]
    assert sorted((r["n"], r["fault"]) for r in refused_keys(rows, "k").collect()) == [(1, "empty"), (2, "empty"), (3, "too large")]


def test_prefix_reaches_the_scan(spark, tmp_path):
    from keylode.operators.scan import scan

    spark.range(10).selectExpr("cast(cast(id as string) as binary) as b", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = scan(table, "b", b"1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(b" in plan and "LessThan(b" in plan
    assert "StringStartsWith(s,1)" in scan(table, "s", "1")._jdf.queryExecution().executedPlan().toString()


def test_an_empty_stream_has_an_empty_state(spark, tmp_path):
    from pyspark.sql import types as T

    from keylode.streaming.latest import stream_latest

    (tmp_path / "in").mkdir()
    shape = T.StructType().add("k", "long").add("at", "long").add("v", "string")
    last = stream_latest(spark, shape, str(tmp_path / "in"), "k", ["at"], ["v"], f"file://{tmp_path}/out")
    rows = spark.read.parquet(last)
    assert rows.columns == ["k", "v"] and rows.count() == 0
