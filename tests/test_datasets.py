"""JSON lines, mutation and whole datasets."""

import datetime
import decimal
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkeel.errors import DatasetError, StateError
from ledgerkeel.functions import rendering
from ledgerkeel.operators import mutate, validate
from ledgerkeel.plans import config, dataset
from ledgerkeel.plans.config import DataFile, DataSet
from ledgerkeel.sources import jsonl, payloads, status, tables

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])

BAD = ['{"a":1} x', '{"a":1}{"b":2}', '{"a":1}]', '{"a":1},{"b":2}', '[{"id":3}]', "5", "{bad", '{"id":1}],[{"id":2}', '{"id":1},"x"', '"s"', "null"]


@pytest.mark.parametrize("line", BAD)
def test_bad_lines(spark, tmp_path, line):
    (tmp_path / "f.jsonl").write_text('{"id":1}\n' + line + "\n")
    with pytest.raises(PySparkException, match="not one JSON object"):
        jsonl.jsonl_scan(spark, str(tmp_path), SCHEMA).collect()


def test_good_lines(spark, tmp_path, rows):
    (tmp_path / "f.jsonl").write_text('\n  {"id": 1, "name": "é"} \r\n\t\n{"name":null}\n{"id":2}')
    assert rows(jsonl.jsonl_scan(spark, str(tmp_path), SCHEMA)) == [(1, "é"), (2, None), (None, None)]


def test_type_and_column_and_utf8_errors(spark, tmp_path):
    (tmp_path / "f.jsonl").write_bytes(b'{"id":"x"}\n{"id":1,"zz":2}\n{"name":"\xff\xfe"}\n')
    found = jsonl.checked_lines(jsonl.read_lines(spark, str(tmp_path)), SCHEMA)
    errors = sorted(r["error"] for r in found.collect())
    assert errors == ["not UTF-8", "unknown columns: zz", "values not of the column type: id"]


def test_rendering(spark):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 120)
    data = [(decimal.Decimal("1.500"), when, when.replace(microsecond=0), when.date(), b"\x0f\xa0", None, {"k": when.date()}, [b"\x01"])]
    schema = "d decimal(9,3), t timestamp_ntz, s timestamp_ntz, y date, b binary, n string, m map<string,date>, a array<binary>"
    df = spark.createDataFrame(data, schema).withColumn("z", F.expr("TIMESTAMP'2024-01-02 03:04:05Z'")).withColumn("st", F.struct(F.lit(1).alias("b"), F.lit(2).alias("a")))
    line = df.select(rendering.json_line(df.schema)).first()[0]
    assert json.loads(line) == {
        "d": "1.500", "t": "2024-05-06T07:08:09.000120", "s": "2024-05-06T07:08:09", "y": "2024-05-06", "b": "0fa0",
        "n": None, "m": {"k": "2024-05-06"}, "a": ["01"], "z": "2024-01-02T03:04:05+00:00", "st": {"a": 2, "b": 1},
    }
    assert list(json.loads(line)) == sorted(json.loads(line))
    assert '"st":{"a":2,"b":1}' in line


TARGET = [(1, "a"), (2, "b"), (None, "n")]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, SCHEMA)


def test_upsert(spark, target, rows):
    new = spark.createDataFrame([(2, "B"), (None, "m"), (3, None)], SCHEMA)
    once = mutate.apply_upsert(target, new, ["id"])
    assert rows(once) == sorted([(1, "a"), (2, "B"), (3, None), (None, "n"), (None, "m")], key=repr)
    keyed = new.dropna(subset=["id"])
    first = mutate.apply_upsert(target, keyed, ["id"])
    assert rows(mutate.apply_upsert(first, keyed, ["id"])) == rows(first)


def test_upsert_partial_rows(spark, target, rows):
    ids = spark.createDataFrame([(2,), (4,)], "id bigint")
    assert rows(mutate.apply_upsert(target, ids, ["id"])) == sorted([(1, "a"), (2, None), (4, None), (None, "n")], key=repr)
    given = spark.createDataFrame([(1, None, ["id", "name"]), (2, None, ["id"]), (4, None, ["id"])], "id bigint, name string, p array<string>")
    kept = mutate.apply_upsert(target, given, ["id"], missing="keep", present="p")
    assert rows(kept) == sorted([(1, None), (2, "b"), (4, None), (None, "n")], key=repr)


def test_duplicate_keys(spark, target, rows):
    twice = spark.createDataFrame([(2, "x"), (2, "y")], SCHEMA)
    with pytest.raises(PySparkException, match="duplicate upsert key"):
        mutate.apply_upsert(target, twice, ["id"]).collect()
    both = mutate.apply_upsert(target, twice, ["id"], on_duplicate="insert_all")
    assert rows(both) == sorted([(1, "a"), (2, "x"), (2, "y"), (None, "n")], key=repr)


def test_mutation_errors(target):
    with pytest.raises(DatasetError, match="requires on"):
        mutate.apply_rows(target, target, "upsert")
    with pytest.raises(DatasetError, match="unsupported mode"):
        mutate.apply_rows(target, target, "merge")
    with pytest.raises(DatasetError, match="unknown column"):
        mutate.apply_insert(target, target.withColumn("extra", F.lit(1)))
    with pytest.raises(DatasetError, match="missing upsert key"):
        mutate.apply_upsert(target, target, ["nope"])


def manifest(tmp_path, text):
    path = tmp_path / "data.toml"
    path.write_text(text)
    return config.load_dataset_config(path, str(tmp_path))


def test_manifest(tmp_path):
    sets = manifest(tmp_path, '[core]\nfiles=[{name="roles",table="t",mode="upsert",on="id"},{name="sub/x.jsonl",table="u",mode="replace",order_by=["a","b"]}]')
    first, second = sets[0].files
    assert (first.name, first.on, first.order_by, first.path) == ("roles", ("id",), None, f"{tmp_path}/roles.jsonl")
    assert (second.name, second.order_by, second.path) == ("x", ("a", "b"), f"{tmp_path}/sub/x.jsonl")
    assert validate.resolve_order_by(first) == ("id",)
    assert config.select_dataset(sets) is sets[0]


@pytest.mark.parametrize(
    "text,error",
    [
        ('[c]\nfiles=[{name="a",table="t",mode="upsert"}]', "requires on"),
        ('[c]\nfiles=[{name="a",table="t",mode="merge"}]', "unsupported mode"),
        ('[c]\nfiles=[{name="a",table=1,mode="insert"}]', "must be a string"),
        ('[c]\nfiles=[{name="a",table="t",mode="insert",x=1}]', "unsupported keys"),
        ('[c]\nother=1\nfiles=[]', "unsupported keys"),
        ("[c]\n", "files array"),
        ("c=1", "must be a table"),
        ("[c]\nfiles=[1]", "must be a table"),
        ('[c]\nfiles=[{name="a",table="t",mode="insert",order_by=[]}]', "is empty"),
        ('[c]\nfiles=[{name="a",table="t",mode="insert",order_by=[1]}]', "not names"),
        ('[c]\nfiles=[{name="a",table="t",mode="insert",on=1}]', "string or an array"),
        ('[c]\nfiles=[{name="../a",table="t",mode="insert"}]', "relative path"),
        ("[c", "cannot parse"),
    ],
)
def test_manifest_errors(tmp_path, text, error):
    with pytest.raises(DatasetError, match=error):
        manifest(tmp_path, text)


def test_set_selection(tmp_path):
    with pytest.raises(DatasetError, match="no data sets"):
        config.select_dataset(())
    with pytest.raises(DatasetError, match="cannot read"):
        config.load_dataset_config(tmp_path / "none.toml", "x")
    two = (DataSet("core", ()), DataSet("demo", ()))
    with pytest.raises(DatasetError, match="core, demo"):
        config.select_dataset(two)
    with pytest.raises(DatasetError, match="unknown data set"):
        config.select_dataset(two, "x")
    assert config.select_dataset(two, "demo") is two[1]


@pytest.fixture
def roles(spark, tmp_path):
    name = f"roles_{tmp_path.name.replace('-', '_')}"
    df = spark.createDataFrame([(2, "viewer"), (1, "admin")], SCHEMA)
    df.write.mode("overwrite").option("path", str(tmp_path / "table")).saveAsTable(name)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_export_edit_apply(spark, roles, tmp_path, rows):
    data = DataFile("roles", roles, "replace", str(tmp_path / "roles.jsonl"), order_by=("id",))
    out = dataset.export_dataset(spark, DataSet("core", (data,)))
    assert rows(out) == [("roles", roles, "replace", 2)]
    assert text_of(tmp_path / "roles.jsonl") == '{"id":1,"name":"admin"}\n{"id":2,"name":"viewer"}\n'
    edited = tmp_path / "edited.jsonl"
    edited.write_text('{"id":3,"name":"owner"}\n{"id":4,"name":"member"}\n')
    done = dataset.apply_dataset(spark, DataSet("core", (DataFile("roles", roles, "replace", str(edited)),)))
    assert rows(done, "rows") == [(2,)]
    assert rows(spark.table(roles)) == [(3, "owner"), (4, "member")]


@pytest.mark.parametrize(
    "mode,text,expected",
    [
        ("insert", "", [(1, "admin"), (2, "viewer")]),
        ("insert", '{"id":1}', [(1, "admin"), (1, None), (2, "viewer")]),
        ("replace", "", []),
        ("upsert", "", [(1, "admin"), (2, "viewer")]),
        ("upsert", '{"id":1,"name":"root"}\n{"id":9,"name":"x"}', [(1, "root"), (2, "viewer"), (9, "x")]),
    ],
)
def test_modes(spark, roles, tmp_path, rows, mode, text, expected):
    path = tmp_path / "f.jsonl"
    path.write_text(text)
    data = DataFile("f", roles, mode, str(path), on=("id",) if mode == "upsert" else None)
    dataset.apply_dataset(spark, DataSet("core", (data,)))
    assert rows(spark.table(roles)) == sorted(expected, key=repr)


def test_nothing_is_written_when_a_later_file_is_bad(spark, roles, tmp_path, rows):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id":7}')
    for text, error in (('{"id":1,"oops":2,"also":3}', "2 unknown column"), ("[1]", "not one JSON object"), ('{"id":1}\n{"id":1}', "repeats key")):
        bad.write_text(text)
        files = (DataFile("good", roles, "insert", str(good)), DataFile("bad", roles, "upsert", str(bad), on=("id",)))
        with pytest.raises(DatasetError, match=error):
            dataset.apply_dataset(spark, DataSet("core", files))
        assert rows(spark.table(roles)) == [(1, "admin"), (2, "viewer")]


def test_guards(spark, roles, tmp_path):
    path = str(tmp_path / "f.jsonl")
    (tmp_path / "f.jsonl").write_text('{"id":7}')
    for data, error in (
        (DataFile("f", roles, "upsert", path, on=("nope",)), "upsert key"),
        (DataFile("f", roles, "insert", path, order_by=("nope",)), "order_by"),
    ):
        with pytest.raises(DatasetError, match=error):
            dataset.apply_dataset(spark, DataSet("c", (data,)))
        with pytest.raises(DatasetError, match="missing order_by"):
            dataset.export_dataset(spark, DataSet("c", (data,)))
    with pytest.raises(DatasetError, match="requires order_by"):
        dataset.export_dataset(spark, DataSet("c", (DataFile("f", roles, "replace", path),)))
    declared = {roles: T.StructType(list(reversed(SCHEMA.fields)))}
    with pytest.raises(StateError, match="declared schema"):
        dataset.apply_dataset(spark, DataSet("c", (DataFile("f", roles, "insert", path),)), declared)
    assert validate.schema_differences(SCHEMA, SCHEMA) == []


@pytest.fixture
def daily(spark, tmp_path):
    name = f"daily_{tmp_path.name.replace('-', '_')}"
    df = spark.createDataFrame([(d, i, "old") for d in ("d1", "d2", "d3") for i in (1, 2)], "day string, id bigint, v string")
    df.write.partitionBy("day").option("path", str(tmp_path / "daily")).saveAsTable(name)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_partitioned_upsert_rewrites_touched_partitions(spark, daily, tmp_path, rows):
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "daily").rglob("*.parquet")}
    (tmp_path / "f.jsonl").write_text('{"day":"d2","id":1,"v":"new"}\n{"day":"d4","id":9,"v":"new"}')
    data = DataFile("f", daily, "upsert", str(tmp_path / "f.jsonl"), on=("day", "id"))
    dataset.apply_dataset(spark, DataSet("c", (data,)))
    got = rows(spark.table(daily), "day", "id", "v")
    assert got == [("d1", 1, "old"), ("d1", 2, "old"), ("d2", 1, "new"), ("d2", 2, "old"), ("d3", 1, "old"), ("d3", 2, "old"), ("d4", 9, "new")]
    # Old files stay where they are; only the touched partitions have new ones, beside the table.
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "daily").rglob("*.parquet")} == before
    new = {p.parent.name for folder in tmp_path.glob("daily__snap_*") for p in folder.rglob("*.parquet")}
    assert new == {"day=d2", "day=d4"}


@pytest.mark.parametrize("listed", [500, 0])
def test_null_partition_keeps_its_rows(spark, daily, tmp_path, rows, monkeypatch, listed):
    monkeypatch.setattr(tables, "LISTED_PARTITIONS", listed)
    tables.append_rows(daily, spark.createDataFrame([(1, "null part", None)], "id bigint, v string, day string"))
    (tmp_path / "f.jsonl").write_text('{"id":1,"v":"second"}\n{"day":"d1","id":1,"v":"new"}')
    dataset.apply_dataset(spark, DataSet("c", (DataFile("f", daily, "upsert", str(tmp_path / "f.jsonl"), on=("day", "id")),)))
    got = rows(spark.table(daily), "day", "id", "v")
    assert [r for r in got if r[0] in (None, "d1")] == sorted(
        [("d1", 1, "new"), ("d1", 2, "old"), (None, 1, "null part"), (None, 1, "second")], key=repr
    )
    assert len(got) == 8


@pytest.mark.parametrize(
    "mode,on,text,expected",
    [
        ("upsert", ("id",), '{"day":"d9","id":1,"v":"new"}', [("d1", 2, "old"), ("d2", 2, "old"), ("d3", 2, "old"), ("d9", 1, "new")]),
        ("replace", None, '{"day":"d9","id":1,"v":"new"}', [("d9", 1, "new")]),
        ("replace", None, "", []),
    ],
)
def test_partitioned_replace(spark, daily, tmp_path, rows, mode, on, text, expected):
    (tmp_path / "f.jsonl").write_text(text)
    dataset.apply_dataset(spark, DataSet("c", (DataFile("f", daily, mode, str(tmp_path / "f.jsonl"), on=on),)))
    assert rows(spark.table(daily), "day", "id", "v") == expected


def test_small_key_side_is_broadcast(spark, target):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = spark.createDataFrame([(2, "B")], SCHEMA)
        plans = [
            mutate.apply_upsert(target, new, ["id"], source_rows=n)._jdf.queryExecution().executedPlan().toString()
            for n in (1, None, mutate.BROADCAST_KEYS + 1)
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False, False]


def test_swap_keeps_old_readers(spark, roles):
    before = tables.table_location(spark, roles)
    after = tables.swap_snapshot(spark, roles, spark.table(roles).where("id = 1"))
    assert before.split(":")[-1] != after.split(":")[-1]
    assert spark.table(roles).count() == 1
    assert spark.read.parquet(before).count() == 2
    tables.swap_snapshot(spark, roles, spark.table(roles).where("id = 2"))
    assert spark.table(roles).count() == 0


def test_payload_scan(spark, tmp_path, rows):
    (tmp_path / "migrations" / "a").mkdir(parents=True)
    (tmp_path / "migrations" / "a" / "1.sql").write_bytes(b"x")
    (tmp_path / "migrations" / "2.sql").write_bytes(b"\xff")
    (tmp_path / "migrations" / "2.txt").write_bytes(b"no")
    got = rows(payloads.payload_scan(spark, str(tmp_path / "migrations"), "migrations"))
    assert [(e, bytes(p)) for e, p in got] == [("migrations/2.sql", b"\xff"), ("migrations/a/1.sql", b"x")]


def test_status(spark, rows):
    texts = {"ok": "[X] migrations/1.sql\n[ ] migrations/2.sql\n\nApplied: 1\nPending: 1", "bad": "[X] a b.sql  \nApplied: 2", "odd": "applied: many"}
    data = [(g, i, line) for g, t in texts.items() for i, line in enumerate(t.split("\n"))]
    df = spark.createDataFrame(data, "grp string, line_no int, line string")
    assert rows(status.applied_scan(df)) == [("bad", 1, "a b.sql"), ("ok", 1, "migrations/1.sql")]
    assert rows(status.status_check(df), "grp", "status") == [("bad", "mismatch"), ("odd", "unreadable"), ("ok", "ok")]


def test_binary_and_nested_values_survive_or_fail(spark, rows):
    from ledgerkeel.functions.rendering import json_line
    from ledgerkeel.sources import jsonl

    df = spark.sql(
        "SELECT 1 AS id, CAST('hello!' AS BINARY) AS raw, array(CAST('a' AS BINARY), NULL) AS list, "
        "map('k', CAST('b' AS BINARY)) AS by_key, named_struct('x', 1L, 'b', CAST('c' AS BINARY)) AS s"
    )
    lines = df.select(json_line(df.schema).alias("value"))
    back = jsonl.parse_lines(lines, df.schema)
    assert rows(back.select("id", "raw", "list", "by_key", "s")) == rows(df)
    bad = ['{"s":{"x":"bad"}}', '{"s":{"x":1,"zz":2}}', '{"raw":"xyz"}', '{"list":["61","q"]}', '{"s":3}', '{"list":[{"a":1}]}']
    for line in bad:
        one = spark.createDataFrame([(line,)], "value string")
        assert jsonl.checked_lines(one, df.schema).first()["error"], line
        with pytest.raises(Exception):  # noqa: B017
            jsonl.parse_lines(one, df.schema).count()


def test_odd_column_names_are_read(spark):
    from ledgerkeel.sources import jsonl

    schema = T.StructType([T.StructField('a"b', T.LongType()), T.StructField("c'd", T.LongType())])
    one = spark.createDataFrame([('{"a\\"b":1,"c\'d":2}',), ('{"a\\"b":"x"}',)], "value string")
    got = [r["error"] for r in jsonl.checked_lines(one, schema).collect()]
    assert got[0] is None and got[1]


def test_repeated_keys_fail_on_an_empty_target(spark):
    target = spark.createDataFrame([], "k int, v string")
    with pytest.raises(Exception, match="duplicate upsert key"):
        mutate.apply_upsert(target, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()
    some = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, v string")
    assert mutate.apply_upsert(target, some, ["k"]).count() == 3


def test_bucketed_and_oddly_named_tables(spark):
    from ledgerkeel.sources import tables

    spark.sql("CREATE TABLE bucketed_t (k INT, v STRING) USING parquet CLUSTERED BY (k) INTO 2 BUCKETS")
    tables.replace_content(spark, "bucketed_t", spark.createDataFrame([(1, "a")], "k int, v string"))
    assert spark.table("bucketed_t").count() == 1
    spark.sql("CREATE TABLE named_t (Location INT, Provider STRING) USING parquet")
    tables.replace_content(spark, "named_t", spark.createDataFrame([(1, "a")], "Location int, Provider string"))
    assert spark.table("named_t").count() == 1


def test_upsert_options_of_a_data_file(spark, tmp_path, rows):
    from ledgerkeel.plans import dataset
    from ledgerkeel.plans.config import DataFile, DataSet

    def applied(lines, **options):
        name = f"options_{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string").write.saveAsTable(name)
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text(lines)
        dataset.apply_dataset(spark, DataSet("s", (DataFile("f", name, "upsert", str(path), on=("k",), **options),)))
        return rows(spark.table(name))

    some = '{"k":1,"v":"n"}\n{"k":3,"w":null}'
    assert applied(some) == [(1, "n", None), (2, "b", "y"), (3, None, None)]
    assert applied(some, missing="keep") == [(1, "n", "x"), (2, "b", "y"), (3, None, None)]
    twice = '{"k":1,"v":"n"}\n{"k":1,"v":"m"}'
    assert applied(twice, on_duplicate="insert_all") == [(1, "m", None), (1, "n", None), (2, "b", "y")]


def test_a_shut_gate_refuses_the_set(spark, tmp_path):
    from ledgerkeel.errors import StateError
    from ledgerkeel.plans import dataset
    from ledgerkeel.plans.config import DataSet

    gate = "grp string, is_clean boolean, prefix_ok boolean, not_ahead boolean, matches boolean, open boolean"
    good = [("a", True, True, True, True, True)]
    dataset.apply_dataset(spark, DataSet("s", ()), gate=spark.createDataFrame(good, gate))
    shut = spark.createDataFrame([*good, ("b", False, True, True, True, False)], gate)
    for call in (dataset.apply_dataset, dataset.export_dataset):
        with pytest.raises(StateError, match="1 group"):
            call(spark, DataSet("s", ()), gate=shut)


@pytest.mark.parametrize("options", [{}, {"missing": "keep", "present": "p"}, {"missing": "keep", "present": "p", "source_rows": 2}])
@pytest.mark.parametrize("held", [[], [(2, "old", "w")], [(None, "n", "w")]])
def test_no_plan_returns_a_repeated_key(spark, options, held):
    target = spark.createDataFrame(held, "k int, v string, w string")
    twice = spark.createDataFrame([(2, "x", ["k", "v"]), (2, "y", ["k", "v"])], "k int, v string, p array<string>")
    rows = twice if options else twice.drop("p")
    out = mutate.apply_upsert(target, rows, ["k"], **options)
    for part in (out, out.where("v = 'x' OR v = 'y'"), out.select("k"), out.where("k = 2")):
        # Spark wraps the error where two stages meet it.
        with pytest.raises(Exception, match="duplicate upsert key"):
            part.collect()


@pytest.mark.parametrize("source_rows", [None, 6])
def test_keep_mode_is_one_outer_join(spark, rows, source_rows):
    held = [(1, "a", 1), (2, "b", 2), (2, "c", 3), (None, "n", 4)]
    target = spark.createDataFrame(held, "k int, v string, w bigint")
    given = [(1, None, ["k", "v"]), (2, None, ["k"]), (3, "new", ["k", "v"]), (4, None, ["k"]), (None, "m", ["v"])]
    new = spark.createDataFrame(given, "k int, v string, p array<string>")
    out = mutate.apply_upsert(target, new, ["k"], missing="keep", present="p", source_rows=source_rows)
    want = [(1, None, 1), (2, "b", 2), (2, "c", 3), (None, "n", 4), (3, "new", None), (4, None, None), (None, "m", None)]
    assert rows(out) == sorted(want, key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    if source_rows is None:
        assert plan.count("SortMergeJoin") == 1 and "FullOuter" in plan
    else:
        assert plan.count("BroadcastHashJoin") == 2


def test_values_are_never_rounded(spark):
    from ledgerkeel.sources import jsonl

    schema = T.StructType.fromDDL("d decimal(5,2), x double, a array<decimal(3,1)>, s struct<d: decimal(4,0), f: float>, m map<string, double>")
    good = ['{"d":1.23}', '{"d":"1.20"}', '{"d":1.2300}', '{"d":123e-2}', '{"x":1e300,"m":{"k":null}}', '{"a":[1.5,"2.0",null]}', '{"s":{"d":12,"f":null}}', '{"d":null}']
    bad = ['{"d":1.239}', '{"d":"1.239"}', '{"d":12345e-4}', '{"d":1234.5}', '{"d":"x"}', '{"d":true}', '{"d":{}}', '{"d":""}', '{"x":"NaN"}', '{"x":"Infinity"}', '{"x":"-INF"}', '{"a":[1.55]}', '{"s":{"d":1.5}}', '{"s":{"f":"NaN"}}', '{"m":{"k":"NaN"}}']
    lines = spark.createDataFrame([(v,) for v in good + bad], "value string")
    found = {r["value"]: r["error"] for r in jsonl.checked_lines(lines, schema).collect()}
    assert [v for v in good if found[v]] == [] and [v for v in bad if not found[v]] == []
    read = jsonl.parse_lines(lines.where(F.col("value").isin(good[:4])), schema)
    assert sorted(str(r["d"]) for r in read.collect()) == ["1.20", "1.23", "1.23", "1.23"]


def test_unknown_fields_inside_arrays_and_maps(spark):
    from ledgerkeel.sources import jsonl

    schema = T.StructType.fromDDL("a array<struct<k: int, n: array<struct<z: int>>>>, m map<string, struct<k: int>>")
    cases = {
        '{"a":[{"k":1},{"k":2,"q":3}]}': "unknown columns: a.q",
        '{"a":[{"n":[{"z":1},{"y":1}]}]}': "unknown columns: a.n.y",
        '{"m":{"one":{"k":1,"p":2}}}': "unknown columns: m.p",
        '{"a":[{"k":1,"n":[]}],"m":{"one":{"k":1}}}': None,
        '{"a":null,"m":null}': None,
        '{"a":[null]}': None,
    }
    lines = spark.createDataFrame([(v,) for v in cases], "value string")
    assert {r["value"]: r["error"] for r in jsonl.checked_lines(lines, schema).collect()} == cases


def test_all_files_or_none(spark, daily, roles, tmp_path, rows, monkeypatch):
    """A failure while a later file is staged, or while locations change, leaves every table as it was."""
    other = f"other_{daily}"
    spark.createDataFrame([(1, "a")], "id bigint, v string").write.saveAsTable(other)
    (tmp_path / "a.jsonl").write_text('{"day":"d2","id":1,"v":"new"}\n{"day":"d9","id":1,"v":"new"}')
    (tmp_path / "b.jsonl").write_text('{"id":2,"v":"b"}')
    files = (
        DataFile("a", daily, "upsert", str(tmp_path / "a.jsonl"), on=("day", "id")),
        DataFile("b", other, "replace", str(tmp_path / "b.jsonl")),
    )
    before = [rows(spark.table(t)) for t in (daily, other)]
    for step in ("stage_replace", "_move"):
        plain = getattr(tables, step)

        def failing(*args, plain=plain, step=step):
            if step == "stage_replace" or "d9" in args[2]:
                raise RuntimeError("lost")
            return plain(*args)

        monkeypatch.setattr(tables, step, failing)
        with pytest.raises(RuntimeError, match="lost"):
            dataset.apply_dataset(spark, DataSet("s", files))
        monkeypatch.setattr(tables, step, plain)
        assert [rows(spark.table(t)) for t in (daily, other)] == before
    dataset.apply_dataset(spark, DataSet("s", files))
    assert rows(spark.table(other)) == [(2, "b")] and spark.table(daily).where("v = 'new'").count() == 2
    spark.sql(f"DROP TABLE {other}")


def test_files_of_one_table_build_on_each_other(spark, tmp_path, rows):
    spark.createDataFrame([(1, "a")], "k int, v string").write.saveAsTable("chained_t")
    texts = ['{"k":2,"v":"b"}', '{"k":2,"v":"c"}\n{"k":3,"v":"d"}', '{"k":4,"v":"e"}', '{"k":9,"v":"x"}']
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.jsonl").write_text(text)

    def data(i, mode, **options):
        return DataFile(str(i), "chained_t", mode, str(tmp_path / f"{i}.jsonl"), **options)

    dataset.apply_dataset(spark, DataSet("s", (data(0, "insert"), data(1, "upsert", on=("k",)), data(2, "insert"))))
    assert rows(spark.table("chained_t")) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]
    dataset.apply_dataset(spark, DataSet("s", (data(0, "insert"), data(3, "replace"), data(2, "insert"))))
    assert rows(spark.table("chained_t")) == [(4, "e"), (9, "x")]
    spark.sql("DROP TABLE chained_t")


def test_odd_partition_values(spark, tmp_path, rows):
    """Quotes, slashes, blanks, null and emptied partitions move like any other."""
    values = ["it's", "a/b", "c d", "e=f", "g\\h", "é%", None]
    start = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, p string")
    start.write.partitionBy("p").option("path", str(tmp_path / "odd")).saveAsTable("odd_t")
    for _ in range(2):
        content = spark.table("odd_t").withColumn("k", F.col("k") + 10)
        tables.switch(spark, [tables.stage_partitions(spark, "odd_t", content, content)])
    assert rows(spark.table("odd_t")) == sorted([(i + 20, v) for i, v in enumerate(values)], key=repr)
    touched = spark.table("odd_t").where("p IS NULL OR p = 'a/b'")
    tables.switch(spark, [tables.stage_partitions(spark, "odd_t", touched.where("p = 'a/b'"), touched)])
    assert rows(spark.table("odd_t")) == sorted([(i + 20, v) for i, v in enumerate(values) if v is not None], key=repr)
    tables.replace_content(spark, "odd_t", spark.createDataFrame([(5, "new")], "k int, p string"))
    assert rows(spark.table("odd_t")) == [(5, "new")]
    spark.sql("DROP TABLE odd_t")


@pytest.mark.parametrize("options", [{}, {"missing": "keep"}])
@pytest.mark.parametrize("parted", [False, True])
def test_upsert_keeps_buckets(spark, tmp_path, rows, options, parted):
    """The target is not shuffled, every row lies in the file of its bucket, and joins still use the buckets."""
    name = f"buckets_{parted}_{len(options)}"
    start = spark.range(1_000).selectExpr("CAST(id AS INT) AS k", "concat('v', id) AS v", "'w' AS w", "id % 2 AS p")
    writer = start.write.bucketBy(4, "k").sortBy("k")
    (writer.partitionBy("p") if parted else writer).saveAsTable(name)
    lines = [f'{{"k":{k},"v":"new","p":{k % 2}}}' for k in range(0, 2_000, 7)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    data = DataFile("f", name, "upsert", str(tmp_path / "f.jsonl"), on=("k",), **options)
    dataset.apply_dataset(spark, DataSet("s", (data,)))
    kept = "w" if options else None
    want = {k: (f"v{k}", "w") for k in range(1_000)} | {k: ("new", kept if k < 1_000 else None) for k in range(0, 2_000, 7)}
    assert rows(spark.table(name), "k", "v", "w") == sorted(((k, *v) for k, v in want.items()), key=repr)
    of_file = F.regexp_extract(F.input_file_name(), r"_([0-9]{5})\.", 1).cast("int")
    placed = spark.table(name).select("k", of_file.alias("file"))
    assert placed.where(F.pmod(F.hash("k"), F.lit(4)) != F.col("file")).count() == 0
    assert tables.bucket_columns(tables.table_details(spark, name)) == (4, ["k"], ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        new = spark.createDataFrame([(1, "x", ["k", "v"])], "k int, v string, p array<string>")
        extra = {"missing": "keep", "present": "p"} if options else {}
        source = new if options else new.drop("p")
        plan = mutate.apply_upsert(spark.table(name), source, ["k"], buckets=(4, ["k"]), **extra)
        text = plan._jdf.queryExecution().executedPlan().toString()
        join = spark.table(name).alias("a").join(spark.table(name).alias("b"), "k")
        assert "Exchange" not in join._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = text.splitlines().index(next(line for line in text.splitlines() if "FileScan" in line))
    depth = [line.find("+-") if "+-" in line else line.find(":-") for line in text.splitlines()]
    above = [text.splitlines()[i] for i in range(scan) if all(depth[i] < depth[j] for j in range(i + 1, scan + 1))]
    assert not any("Exchange" in line for line in above) and any("SortMergeJoin" in line for line in above)
    spark.sql(f"DROP TABLE {name}")
