import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylode import errors
from keylode.functions import keys
from keylode.operators import log, scan
from keylode.plans.latest import latest
from keylode.pool import LineManager, LogManager, Pool, SortedManager, checked_name, stats_frame
from keylode.runtime import ship
from keylode.sources import lines, sorted_table
from keylode.stores import Bucket, LineFileStore, LineStore, LogStore, Options

FIELDS = st.sampled_from(["id", "ID", "a", "b c", "é"])
PLAIN = st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=6))
VALUES = st.recursive(PLAIN, lambda x: st.lists(x, max_size=3) | st.dictionaries(FIELDS, x, max_size=3), max_leaves=6)


@given(st.lists(st.tuples(FIELDS, VALUES), max_size=5), st.sampled_from([(",", ":"), (" , ", " : ")]))
@settings(max_examples=300, deadline=None)
def test_key_of_an_object_is_its_first_field_of_that_name(members, seps):
    # members are written one by one, so names may repeat
    line = "{" + seps[0].join(json.dumps(k) + seps[1] + json.dumps(v) for k, v in members) + "}"
    first = next((v for k, v in members if k == "id"), None)
    want = first.encode() if isinstance(first, str) and first else None
    assert keys.parse_key(line, "id") == want and keys.parse_key(line.encode(), "id") == want
    last = [v for k, v in members if k == "id"][-1:]
    found = keys.raw_field(line, "id")
    assert [found] == ([json.dumps(v) for v in last] or [None])


@given(st.dictionaries(FIELDS, VALUES, max_size=3), st.integers(0, 200), st.text(" x}1", min_size=1, max_size=3))
@settings(max_examples=300, deadline=None)
def test_no_key_in_what_is_not_one_object(others, cut, more):
    line = json.dumps({"id": "k", **{k: v for k, v in others.items() if k != "id"}})
    assert keys.parse_key(line, "id") == b"k"
    assert keys.parse_key(line[: cut % len(line)], "id") is None
    assert keys.parse_key(line + more, "id") == (None if more.strip() else b"k")
    for whole in (f"[{line}]", json.dumps(line), line.replace('"', "'"), line[:-1] + ',"z":NaN}'):
        assert keys.parse_key(whole, "id") is None


@pytest.mark.parametrize("value", ["[1,2,3]", '"a string"', "42", "true", "null", '{"b": 1.50,  "a":2}'])
def test_raw_value_is_verbatim(value):
    assert keys.raw_field(f'{{"id":"k", "value": {value} }}', "value") == value
    assert keys.raw_field(f'{{"value":1,"value":{value}}}', "value") == value


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_parsers_never_raise(text):
    keys.parse_key(text, "id")
    keys.raw_field(text, "id")


@pytest.mark.parametrize(("prefix", "after"), [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"", None)])
def test_successor(prefix, after):
    assert scan.successor(prefix) == after


@pytest.fixture
def json_key():
    return sorted_table.KeyFunction("json:id", lambda line: keys.json_string_key("id")(line))


CSV = sorted_table.KeyFunction("csv", keys.before_comma)


def csv_key(line):
    at = line.find(b",")
    return line[:at] if at > 0 else None


def test_lines_keep_bytes_and_places(spark, tmp_path):
    raw = b"a,1\n\nno\r\n,x\n\xff\xfe,2\nb,3"
    (tmp_path / "f").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")
    try:
        found = sorted((r["src_off"], bytes(r["line"])) for r in lines.lines(spark, str(tmp_path / "f")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, at = [], 0
    for line in raw.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    assert found == want


def test_log_store(spark, tmp_path):
    path = str(tmp_path / "db")
    db = LogStore(spark, path, Options(segment_bytes=200))
    with pytest.raises(errors.EmptyKey):
        db.put(b"", b"x")
    with pytest.raises(errors.KeyTooLarge):
        db.put(b"x" * 65536, b"")
    model, r = {}, random.Random(42)
    for i in range(120):
        k = f"k{r.randrange(20):02d}".encode()
        if r.random() < 0.66:
            db.put(k, v := f"v{i}".encode())
            model[k] = v
        else:
            db.delete(k)
            model.pop(k, None)
    db.put(b"empty", b"")
    model[b"empty"] = b""
    assert dict(db.all()) == model
    assert [k for k, _ in db.all(b"k", ordered=True, reverse=True)] == sorted((k for k in model if k.startswith(b"k")), reverse=True)
    assert db.get(b"empty") == b"" and db.has(b"empty") and not db.has(b"absent")
    with pytest.raises(errors.NotFound):
        db.get(b"absent")
    stats = db.stats()
    assert stats["keys"] == len(model) and stats["segments"] > 1 and stats["dead_bytes"] > 0
    db.compact()
    assert dict(db.all()) == model
    db.close()
    with pytest.raises(errors.Closed):
        db.get(b"empty")
    assert dict(LogStore(spark, path).all()) == model


def _parts(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_a_snapshot_spares_the_log_before_it(spark, tmp_path):
    home = tmp_path / "db"
    db = LogStore(spark, str(home))
    for i in range(6):
        db.put(f"k{i}", f"v{i}")
    db.close()
    db = LogStore(spark, str(home))
    db.put("k0", "new")
    db.delete("k1")
    want = {b"k0": b"new"} | {f"k{i}".encode(): f"v{i}".encode() for i in range(2, 6)}
    db.sync()
    assert db._state.snapshot[1] == 6 and len(db._tail()) == 1
    assert dict(db.all()) == want and db.get("k0") == b"new" and not db.has("k1") and db.get("k5") == b"v5"
    # without the folder, the whole log is replayed
    (home / db._state.snapshot[0] / "_SUCCESS").unlink()
    again = LogStore(spark, str(home))
    assert not again._state.snapshot and dict(again.all()) == want
    again.close()
    assert again._state.snapshot[1] == 8
    plain = LogStore(spark, str(tmp_path / "plain"), Options(snapshot=False))
    plain.put("a", "1")
    plain.close()
    assert not any(p.startswith("snap") for p in _parts(tmp_path / "plain"))


def test_a_record_that_differs_from_its_checksum_ends_its_segment(spark, tmp_path):
    home = tmp_path / "db"
    db = LogStore(spark, str(home), Options(segment_bytes=100, snapshot=False))
    for i in range(12):
        db.put(f"k{i:02d}", "v" * 10)
    db.close()
    segs = {r["seq"]: r["seg"] for r in LogStore(spark, str(home)).log().collect()}
    rows = db._read(db._state.parts)
    hurt = rows.withColumn("value", F.when(F.col("seq") == 6, F.lit(b"w" * 10)).otherwise(F.col("value")))
    hurt.write.parquet(str(home / "hurt"))
    state = json.loads((home / "state.json").read_text())
    state["parts"][0][0] = "hurt"
    (home / "state.json").write_text(json.dumps(state))
    kept = {r["seq"] for r in LogStore(spark, str(home)).log().collect()}
    assert kept == {q for q, g in segs.items() if g != segs[6] or q < 6} and 6 not in kept
    after = LogStore(spark, str(home))
    after.put("k05", "again")
    assert after.get("k05") == b"again" and {r["seq"] for r in after.log().collect()} == kept | {13}


def test_checksums_agree_and_tell_fields_apart(spark):
    given_ = [(b"ab", b"c", 1, 1), (b"a", b"bc", 1, 1), (b"a", None, 1, 1), (b"a", b"", 1, 1), (b"a", b"", 2, 1), (b"\xff\x00", b"\x80" * 70, 5, 9)]
    rows = spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None, t, q, i) for i, (k, v, t, q) in enumerate(given_)], "key binary, value binary, tombstone boolean, ts_ns long, seq long, i int")
    found = [r[0] for r in rows.orderBy("i").select(log.record_crc()).collect()]
    assert found == [log.crc_of(*x) for x in given_] and len(set(found)) == len(found)


def test_compaction_rewrites_candidates_only(spark, tmp_path):
    home = tmp_path / "db"
    db = LogStore(spark, str(home), Options(segment_bytes=120, sync_on_write=True))
    for k in ("a", "a", "a", "a", "b", "c", "d", "e"):
        db.put(k, "x" * 10)
    before = dict(db.all())
    parts = [p[0] for p in db._state.parts]
    assert len(parts) == 8 and db.compact() == 3
    kept = [p[0] for p in db._state.parts]
    assert set(kept) & set(parts) == set(parts[3:]) and dict(db.all()) == before
    assert set(parts) <= set(_parts(home))  # readers of the old parts can end
    db.close()
    assert not set(parts[:3]) & set(_parts(home)) and dict(LogStore(spark, str(home)).all()) == before


def test_put_replaces_in_one_step(spark, tmp_path, monkeypatch):
    from keylode.files import Files

    files, name = Files(spark), str(tmp_path / "f")
    files.put(name, b"old")
    monkeypatch.setattr(Files, "_over", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        files.put(name, b"new")
    assert files.read(name) == b"old"
    monkeypatch.undo()
    files.put(name, b"new")
    files.append(name, b"er")
    assert files.read(name) == b"newer" and files.last_byte(name) == b"r"


def test_dead_bytes_of_an_overwrite(spark):
    rows = spark.createDataFrame([("k1", "v1", False, 0, 1), ("k2", "v2", False, 0, 2), ("k1", "v1b", False, 0, 3)], "key string, value string, tombstone boolean, seg int, seq long")
    assert log.store_stats(rows).first().asDict() == {"keys": 2, "segments": 1, "dead_bytes": 25}


def test_compaction_keeps_tombstones_that_hide_older_records(spark):
    rows = spark.createDataFrame([("a", "1", False, 0, 1), ("b", "1" * 99, False, 0, 2), ("a", None, True, 1, 3), ("c", "1", False, 2, 4)], "key string, value string, tombstone boolean, seg int, seq long")
    after = log.compacted(rows, 0.5)
    assert {r["key"] for r in latest(after, "key", ["seq"], [], F.col("tombstone")).collect()} == {"b", "c"}


def test_bad_record_truncates_its_segment_only(spark):
    rows = spark.range(30).selectExpr("cast(id div 10 as int) as seg", "id as seq")
    kept = log.intact(rows, F.col("seq").isin(10, 25))
    assert sorted(r["seq"] for r in kept.collect()) == [*range(10), *range(20, 25)]


def test_bloom_size():
    assert log.bloom_size(2000, 0.01) == (19171, 7) and log.bloom_size(0, 0.01)[0] == 8


def test_line_store(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"k,v0\nk,v1\na,1\n\nnocomma\n,leading\nb,2")
    store = LineStore(spark, str(path), keys.before_comma, csv_key)
    assert dict(store.all()) == {b"k": b"k,v1", b"a": b"a,1", b"b": b"b,2"}
    with pytest.raises(errors.NoLineKey):
        store.put(b"nokeyhere")
    with pytest.raises(errors.InvalidLine):
        store.put(b"a,em\nbedded")
    store.put(b"c,3")
    store.delete(b"a")
    assert not store.has(b"a") and store.get(b"c") == b"c,3" and path.read_bytes().endswith(b"b,2\nc,3\n")
    assert LineStore(spark, str(path), keys.before_comma, csv_key).has(b"a")


def test_bucket_over_line_file(spark, tmp_path):
    ship(spark)
    inner = LineStore(spark, str(tmp_path / "f.jsonl"), lambda line: keys.json_string_key("id")(line), lambda x: keys.parse_key(x, "id"))
    store = LineFileStore(inner)
    store.put("k1", b'{"n":42}')
    assert inner.get("k1") == b'{"id":"k1","value":{"n":42}}' and store.get("k1") == b'{"n":42}'
    with pytest.raises(errors.NoLineKey):
        LineFileStore(inner, keys.JsonLineCodec("uuid")).put("x", b"1")


def test_typed_buckets(spark, tmp_path):
    db = LogStore(spark, str(tmp_path / "db"))
    codec = keys.JsonCodec(T.StructType().add("Name", "string").add("Age", "integer"))
    users, teams = Bucket(db, "users:", codec), Bucket(db, "teams:", codec)
    users.put("alice", {"Name": "Alice", "Age": 30})
    users.put("bob", {"Name": "Bob", "Age": 40})
    teams.put("x", {"Name": "X", "Age": 1})
    assert dict(users.all(ordered=True)) == {"alice": {"Name": "Alice", "Age": 30}, "bob": {"Name": "Bob", "Age": 40}}
    assert users.get("alice")["Age"] == 30 and not users.has("x")
    db.put("users:broken", b"{not json")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|Malformed"):
        list(users.all())


def _jsonl(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_sorted_table(spark, tmp_path, json_key):
    ship(spark)
    base = _jsonl(tmp_path / "base", [{"id": "a", "s": "pending"}, {"id": "b", "s": "pending"}, {"id": "c", "s": "pending"}, {"n": 1}])
    one = _jsonl(tmp_path / "one", [{"id": "b", "s": "done"}, {"id": "a", "s": "done"}])
    two = _jsonl(tmp_path / "two", [{"id": "a", "s": "change2"}])
    out = str(tmp_path / "table")
    table = sorted_table.ensure_fresh(spark, [base, one], out, json_key)
    assert [json.loads(v)["s"] for _, v in table.rows()] == ["done", "done", "pending"] and len(table) == 3
    version = table.manifest["version"]
    assert sorted_table.ensure_fresh(spark, [base, one], out, json_key).manifest["version"] == version
    refreshed = sorted_table.ensure_fresh(spark, [base, one, two], out, json_key)
    rebuilt = str(tmp_path / "rebuilt")
    sorted_table.build(spark, [base, one, two], json_key, rebuilt)
    assert list(refreshed.rows()) == list(sorted_table.SortedTable(spark, rebuilt).rows())
    assert json.loads(refreshed.get("a"))["s"] == "change2" and not refreshed.has("zz")
    assert [bytes(r["key"]) for r in refreshed.filter_all(F.col("line").cast("string").contains("pending")).collect()] == [b"c"]
    with pytest.raises(errors.EmptyKey):
        refreshed.get("")
    with pytest.raises(errors.NotFound):
        refreshed.get("zz")
    refreshed.close()
    with pytest.raises(errors.Closed):
        refreshed.has("a")
    other = sorted_table.ensure_fresh(spark, [base, one, two], out, json_key, sorted_table.Options(bloom_fpr=-1))
    assert other.manifest["options"]["bloom_fpr"] == -1 and other.has("a")
    (tmp_path / "table" / "manifest.json").write_text("{}")
    with pytest.raises(errors.Corrupt):
        sorted_table.SortedTable(spark, out)


@pytest.mark.parametrize("interval", [0, 100])
def test_row_groups_and_misses(spark, tmp_path, interval):
    import pyarrow.parquet as pq

    (tmp_path / "f").write_text("".join(f"k{i:04d},{i}\n" for i in range(1000)))
    sorted_table.build(spark, [str(tmp_path / "f")], CSV, str(tmp_path / "t"), sorted_table.Options(sparse_interval=interval))
    table = sorted_table.SortedTable(spark, str(tmp_path / "t"))
    meta = [pq.ParquetFile(p).metadata for p in (tmp_path / "t" / table.manifest["version"]).glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in meta for i in range(m.num_row_groups)]
    assert sum(groups) == 1000 and (max(groups) == 100 if interval else len(groups) == len(meta))
    assert all(table.has(f"k{i:04d}") for i in (0, 99, 100, 999)) and not table.has("k0500x")


def test_empty_sources_keep_the_schema(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"nokey\n\n")
    sorted_table.build(spark, [str(tmp_path / "f")], CSV, str(tmp_path / "t"))
    table = sorted_table.SortedTable(spark, str(tmp_path / "t"))
    assert len(table) == 0 and table.table().schema == sorted_table.SCHEMA
    with pytest.raises(FileNotFoundError):
        sorted_table.build(spark, [str(tmp_path / "absent")], CSV, str(tmp_path / "t"))


SOURCES = st.lists(st.fixed_dictionaries({"path": st.sampled_from("pqrs"), "size": st.integers(0, 2), "mtime_ns": st.integers(0, 2)}), max_size=4)


@given(SOURCES, SOURCES)
@settings(max_examples=300, deadline=None)
def test_decide(recorded, more):
    assert sorted_table.decide(recorded, recorded) == "fresh"
    if more:
        assert sorted_table.decide(recorded, recorded + more) == ("refresh" if recorded else "rebuild")
        assert sorted_table.decide(recorded + more, recorded) == "rebuild"
    for i, one in enumerate(recorded):
        for name in ("size", "mtime_ns"):
            changed = [*recorded[:i], {**one, name: one[name] + 1}, *recorded[i + 1 :]]
            assert sorted_table.decide(recorded, changed + more) == "rebuild"
    if recorded[::-1] != recorded:
        assert sorted_table.decide(recorded, recorded[::-1] + more) == "rebuild"


def test_refresh_does_not_read_sources_it_has(spark, tmp_path, monkeypatch):
    for name, text in (("one", "a,1\nb,1\n"), ("two", "b,2\n")):
        (tmp_path / name).write_text(text)
    one, two, out = str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "t")
    sorted_table.build(spark, [one], CSV, out)
    read, real = [], lines.sources
    monkeypatch.setattr(lines, "sources", lambda spark, paths, key, first=0: (read.extend(paths), real(spark, paths, key, first))[1])
    table = sorted_table.ensure_fresh(spark, [one, two], out, CSV)
    assert read == [two] and dict(table.rows()) == {b"a": b"a,1", b"b": b"b,2"}
    (tmp_path / "one").unlink()
    with pytest.raises(FileNotFoundError):
        sorted_table.ensure_fresh(spark, [one, two], out, CSV)


class _Thing:
    def __init__(self):
        self.closed = False

    def close(self):
        self.closed = True


def test_pool():
    now = [0.0]
    pool = Pool(lambda name: _Thing(), idle_s=60, clock=lambda: now[0])
    h = pool.acquire("x")
    thing = h.resource
    now[0] = 600
    pool.sweep()
    assert not thing.closed
    h.close()
    h.close()
    assert pool.stats()[0]["refs"] == 0
    with pytest.raises(errors.Closed):
        _ = h.resource
    now[0] = 659
    pool.sweep()
    assert not thing.closed and pool.stats()[0]["idle_s"] == 59
    now[0] = 660
    pool.sweep()
    assert thing.closed and pool.acquire("x").resource is not thing
    pool.close()
    with pytest.raises(errors.ManagerClosed):
        pool.acquire("x")
    with pytest.raises(errors.ManagerClosed):
        pool.close()


def test_a_thread_closes_what_is_idle():
    pool = Pool(lambda name: _Thing(), idle_s=0.01, sweep_s=0.02)
    with pool.acquire("x") as thing:
        pass
    end = time.monotonic() + 10
    while not thing.closed and time.monotonic() < end:
        time.sleep(0.01)
    assert thing.closed
    pool.close()


def test_managers(spark, tmp_path):
    logs = LogManager(spark, str(tmp_path / "logs"))
    with logs.acquire("x") as db:
        db.put("k", "v")
    logs.close()
    assert LogStore(spark, str(tmp_path / "logs/x")).get("k") == b"v"
    files = LineManager(spark, str(tmp_path), keys.before_comma, csv_key)
    with files.acquire("f") as store:
        store.put("k,1")
    files.close()
    tables = SortedManager(spark, str(tmp_path / "cache"), CSV)
    with pytest.raises(ValueError):
        tables.acquire("t", [])
    with tables.acquire("t", [str(tmp_path / "f")]) as table:
        assert table.get("k") == b"k,1"
    assert stats_frame(spark, tables).where("open and refs = 0 and idle_s >= 0").count() == 1
    tables.close()


@pytest.mark.parametrize("name", ["", ".", "..", "a/b", "a\\b", "a\0b"])
def test_names(name):
    with pytest.raises(ValueError):
        checked_name(name)
