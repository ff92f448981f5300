"""Files in and out: archives, configuration files, logs, host lists, datasets, run tables."""

import bz2
import gzip
import io
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialgrid.operators.grid import ParameterError
from trialgrid.session import scratch_path
from trialgrid.sources import archives, conffiles, datasets, hosts, lines, logs, runlog, warehouse


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_all_suffixes(spark, tmp_path):
    data = b"one\n\ntwo \xc3\xa9\nno end"
    (tmp_path / "a.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.bz2").write_bytes(bz2.compress(data))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as packed:
        packed.writestr("m1.txt", data)
        packed.writestr("dir/m2.txt", b"x\n")
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as packed:
        for name, body in (("m1", data), ("m2", b"")):
            entry = tarfile.TarInfo(name)
            entry.size = len(body)
            packed.addfile(entry, io.BytesIO(body))
    (tmp_path / "e.txt").write_bytes(data)
    (tmp_path / "f.xgz").write_bytes(gzip.compress(data))
    got = archives.read_archives(spark, str(tmp_path))
    lines_of = {}
    for row in got.orderBy("path", "member", "block_start", "row").collect():
        key = (row["name"].rsplit("/", 1)[1], row["kind"], row["member"])
        lines_of.setdefault(key, []).append(row["line"])
    text = ["one", "", "two é", "no end"]
    assert lines_of == {
        ("data-a", "gz", None): text,
        ("data-b", "bz2", None): text,
        ("data-c", "zip", "m1.txt"): text,
        ("data-c", "zip", "dir/m2.txt"): ["x"],
        ("data-d", "tar.gz", "m1"): text,
        ("e.txt", None, None): text,
        ("data-f.", "gz", None): text,
    }


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<configuration>\n<property><name>a</name><value>1</value></property>\n"
        "<property><name>a</name>\n  <value>2</value></property><property><name>e</name><value></value></property>\n"
        "<property><name>n</name></property></configuration>"
    )
    got = conffiles.config_scan_xml(spark, str(tmp_path))
    ordered = [(r["name"], r["value"]) for r in got.orderBy("file", "block_start", "row").collect()]
    assert ordered == [("a", "1"), ("a", "2"), ("e", None), ("n", None)]


def test_props(spark, tmp_path):
    (tmp_path / "d.conf").write_text("# c\n\nspark.master   yarn\nopts\t-a  -b=c \n  indented v\nalone\n")
    got = conffiles.config_scan_props(spark, str(tmp_path)).orderBy("block_start", "row").collect()
    assert [(r["name"], r["value"]) for r in got] == [
        ("spark.master", "yarn"),
        ("opts", "-a  -b=c"),
        ("indented", "v"),
        ("alone", None),
    ]


INI = """; lead
stray = no section
[one]
Key = a, b
Other: x = y ; note
url = http://h;p
rem a remark
multi = first
   second
\tthird

[two]
   lost
key =
quoted = ""
key = again
"""


@pytest.mark.parametrize("ranges", [1, 5])
def test_ini(spark, tmp_path, ranges):
    for name in ("p.ini", "q.ini"):
        (tmp_path / name).write_text(INI)
    got = conffiles.ini_entries(lines.read_lines(spark, str(tmp_path)), ranges)
    one = [(r["section"], r["name"], r["value"]) for r in got.filter("file like '%p.ini'").orderBy("block_start", "row").collect()]
    assert one == [
        ("one", "key", "a, b"),
        ("one", "other", "x = y"),
        ("one", "url", "http://h;p"),
        ("one", "multi", "first\nsecond\nthird"),
        ("two", "key", ""),
        ("two", "quoted", ""),
        ("two", "key", "again"),
    ]
    assert got.count() == 14


def test_ini_rejects(spark, tmp_path):
    (tmp_path / "p.ini").write_text(INI + "garbage line\n")
    got = conffiles.ini_rejects(lines.read_lines(spark, str(tmp_path))).orderBy("block_start", "row").collect()
    assert [(r["line"], r["reason"]) for r in got] == [
        ("stray", "no section"),
        ("   lost", "nothing to continue"),
        ("garbage line", "no option"),
    ]


@pytest.mark.parametrize(
    "text",
    ["a = 1\n[s]\n", "[s]\nno option\n", "[s]\n  lost\n", "[s]\na = %(b)s\n", "[s]\na = %(b)s\nb = %(a)s\n"],
)
def test_wrong_ini_files(spark, tmp_path, text):
    (tmp_path / "p.ini").write_text(text)
    with pytest.raises(ParameterError):
        conffiles.config_scan_ini(spark, str(tmp_path)).collect()


def test_ini_defaults_and_references(spark, tmp_path):
    (tmp_path / "p.ini").write_text(
        "[DEFAULT]\nroot = /r\nkind = x\n[one]\na = %(root)s/%(KIND)s of %(__name__)s at 5%%\nb = 5%% %d\nkind = y\nkind = %(c)s%(c)s\nc = z\n"
        "[empty]\n[DEFAULT]\nroot = /s\n[one]\nc = w\n"
    )
    got = {(r["section"], r["name"]): r["value"] for r in conffiles.config_scan_ini(spark, str(tmp_path)).collect()}
    assert got == {
        ("one", "root"): "/s",
        ("one", "a"): "/s/ww of one at 5%",
        ("one", "b"): "5%% %d",
        ("one", "kind"): "ww",
        ("one", "c"): "w",
        ("empty", "root"): "/s",
        ("empty", "kind"): "x",
    }


def test_positions_feed_the_lookup(spark, tmp_path):
    (tmp_path / "a.conf").write_text("k 1\nk 2\n")
    (tmp_path / "b.conf").write_text("k 3\n")
    found = conffiles.config_scan_props(spark, str(tmp_path))
    rank = found.select("file", F.when(F.endswith("file", F.lit("b.conf")), 0).otherwise(1).alias("file_rank")).distinct()
    from trialgrid.operators.confmerge import config_lookup, config_lookup_many

    placed = conffiles.with_position(found, rank)
    assert config_lookup(placed).first()["value"] == "3"
    only_a = placed.filter("file_rank = 1")
    assert config_lookup(only_a).first()["value"] == "1" and config_lookup_many(only_a).first()["value"] == "2"


def test_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = lines.read_lines(spark, str(tmp_path / "big.log"))
        assert read.rdd.getNumPartitions() > 4
        ordered = [r["line"] for r in read.orderBy("block_start", "row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [f"line {i}" for i in range(5000)]


def test_hosts(spark, tmp_path):
    (tmp_path / "nodes").write_text("b \na\nb\nc\t\na\n")
    names = lambda spec: [r["host"] for r in hosts.read_hosts(spark, spec).orderBy("pos").collect()]
    assert names(str(tmp_path / "nodes")) == ["b", "a", "c"]
    assert names("x,y ,x, z") == ["x", "y", " z"]
    assert names("single ") == ["single"]


def test_history(spark, tmp_path):
    for name in ("job_1_a", "job_12_b", "conf_1", "job_2_c"):
        (tmp_path / name).write_text(f"log of {name}\n")
    files = spark.createDataFrame([(n,) for n in ("job_1_a", "job_12_b", "conf_1", "job_2_c")], "name string")
    scan = lambda ids: [r[0] for r in rows(logs.job_history_scan(files, "name", ids))]
    assert scan(None) == ["job_12_b", "job_1_a", "job_2_c"]
    assert scan(["job_1"]) == ["job_12_b", "job_1_a"]
    table = spark.createDataFrame([("job_1",), ("job_12",), ("conf",), (None,)], "id string")
    assert scan(table) == ["conf_1", "job_12_b", "job_1_a"]
    copied = logs.copy_history(spark, str(tmp_path), scratch_path(spark, "history"), ["job_2"])
    assert [r["line"] for r in copied.collect()] == ["log of job_2_c"]


def test_history_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(logs, "fits_broadcast", lambda ids: False)
    files = spark.createDataFrame([(n,) for n in ("job_1_a", "job_12_b", "x", "job_2_c")], "name string")
    table = spark.createDataFrame([("job_1",), ("job_12",)], "id string")
    assert rows(logs.job_history_scan(files, "name", table)) == [("job_12_b",), ("job_1_a",)]


def test_logs_without_a_job_are_unknown(spark):
    found = spark.createDataFrame(
        [("l1", 2, "mapreduce.Job: Running job: j2"), ("l1", 1, "mapred.JobClient: Running job: j1"), ("l2", 1, "nothing")],
        "log string, no int, line string",
    )
    assert rows(logs.extract_job_id(found, ["log"], ["no"])) == [("l1", "j1"), ("l2", "unknown")]


# Datasets --------------------------------------------------------------------


@pytest.fixture
def text_dir(tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text(name * 39 + "\n")
    return str(tmp_path)


def test_load_takes_whole_files_up_to_the_size(spark, text_dir):
    loads = scratch_path(spark, "loads")
    for cap, files in ((80, 2), (81, 3), (None, 3), (0, 3)):
        dest = scratch_path(spark, "load")
        assert datasets.load_dataset(spark, text_dir, dest, "text", cap, loads=loads).count() == files
    with pytest.warns(UserWarning, match="does not fill up"):
        datasets.load_dataset(spark, text_dir, scratch_path(spark, "load"), "text", 500, loads=loads)
    records = datasets.loaded_datasets(spark, loads).orderBy("raw_bytes", "desired_size").collect()
    assert sorted(r["raw_bytes"] for r in records) == [80, 120, 120, 120, 120]
    assert all(r["final_bytes"] > 0 for r in records)
    assert datasets.clean_datasets(spark, loads) == 5
    with pytest.warns(UserWarning, match="no dataset"):
        datasets.clean_datasets(spark, scratch_path(spark, "none"))


def shout(df):
    return df.select(F.upper("value").alias("value"))


def test_hooks(spark, text_dir, monkeypatch):
    monkeypatch.setattr(F, "shout_for_test", shout, raising=False)
    loaded = datasets.load_dataset(
        spark, text_dir, scratch_path(spark, "load"), "text", hook="pyspark.sql.functions.shout_for_test"
    )
    assert rows(loaded) == [("A" * 39,), ("B" * 39,), ("C" * 39,)]
    double = datasets.batch_hook(lambda pdf: pd.DataFrame({"value": pdf["value"] * 2}), "value string")
    assert datasets.pre_load_hook(loaded, double).count() == 3
    with pytest.raises(datasets.DatasetError):
        datasets.import_function("plain")


def test_paths_are_checked_first(spark, text_dir):
    dest = scratch_path(spark, "ingest")
    with pytest.raises(FileNotFoundError):
        datasets.ingest_files(spark, [text_dir, text_dir + "/missing"], dest, "text")
    assert not runlog.path_exists(spark, dest)
    assert datasets.ingest_files(spark, [text_dir + "/a.txt"], dest, "text").count() == 1


def test_listing_does_not_read_contents(spark, text_dir):
    listed = datasets.file_inventory(spark, text_dir)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert listed.agg(F.sum("length")).first()[0] == 120
    both = datasets.file_inventory(spark, text_dir, directories=True)
    assert sorted(r["kind"] for r in both.collect()) == ["-", "-", "-", "d"]


def test_slots_differ_by_one(spark):
    spread = datasets.round_robin_assign(spark.range(1003), ["id"], 7)
    counts = [r["count"] for r in spread.groupBy("slot").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1
    few = datasets.round_robin_assign(spark.range(3), ["id"], 5)
    path = scratch_path(spark, "slots")
    datasets.write_slots(few, path)
    assert sorted(r["slot"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_generated_text_has_the_size(spark):
    made = datasets.make_dataset(spark, "DynamicDataset", {"words": "alpha beta gamma", "seed": "3"}, 50_000)
    size = made.agg(F.sum(F.octet_length("line") + 1)).first()[0]
    assert 40_000 < size < 60_000
    again = datasets.make_dataset(spark, "DynamicDataset", {"words": "alpha beta gamma", "seed": "3"}, 50_000)
    assert made.exceptAll(again).count() == 0


# Run tables and warehouse ----------------------------------------------------


def test_outputs_by_run(spark):
    outputs = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("run_id"))
    path, dest = scratch_path(spark, "out"), scratch_path(spark, "kept")
    runlog.export_output(outputs, path)
    assert runlog.fetch_output(spark, path, [1, 3]).count() == 50
    gone = spark.createDataFrame([(0,), (2,), (9,)], "run_id int")
    assert {r["run_id"] for r in runlog.drop_output(spark, path, gone, dest).collect()} == {1, 3}
    assert spark.read.parquet(path).count() == 100
    everything = spark.createDataFrame([(i,) for i in range(4)], "run_id int")
    assert runlog.drop_output(spark, path, everything, scratch_path(spark, "none")).count() == 0


def test_summaries(spark):
    runs = spark.createDataFrame(
        [(1, "k", "j1", {"a": "x", "b": "y"}, 1, "done", 1, None, None)], runlog.RUNS
    )
    wide = runlog.run_summary(runlog.run_params(runs), ["run_id", "job_id"], ["a", "b", "c"])
    assert rows(wide) == [(1, "j1", "x", "y", None)]
    props = spark.createDataFrame([(1, "C", {"b": 'q"', "a": "1,2"})], runlog.DATASETS)
    path = scratch_path(spark, "csv")
    runlog.write_csv(runlog.dataset_summary(props), path)
    back = spark.read.option("header", True).csv(path).first()
    assert back["ds_class_properties"] == '{"a":"1,2","b":"q\\""}'


def test_sql_keeps_macro_text(spark):
    before = spark.conf.get("spark.sql.variable.substitute")
    spark.conf.set("spark.sql.variable.substitute", "true")
    try:
        view = spark.createDataFrame([("${x}",)], "v string")
        assert warehouse.warehouse_sql(spark, "select v from macro_view where v = '${x}'", {"macro_view": view}).count() == 1
        assert spark.conf.get("spark.sql.variable.substitute") == "true"
    finally:
        spark.conf.set("spark.sql.variable.substitute", before)


def test_warehouse_tables(spark):
    warehouse.warehouse_namespace(spark, "tg_test", scratch_path(spark, "warehouse"))
    one = warehouse.warehouse_table(spark.range(100), "tg_test", "one", bucket_by="id", buckets=4)
    two = warehouse.warehouse_table(spark.range(50), "tg_test", "two", bucket_by="id", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = one.join(two, "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert warehouse.warehouse_clean(spark, "tg_test") == 2
    assert warehouse.warehouse_clean(spark, "tg_test") == 0
