"""Rules of the column functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from trialgrid.functions import params, text


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(fn(F.col("v"))).collect()]


def python_size(size):
    if 1024 < size < 1048576:
        return " (%.1f KB)" % (float(size) / 1024)
    if 1048576 < size < 1073741824:
        return " (%.1f MB)" % (float(size) / 1048576)
    if size > 1073741824:
        return " (%.1f GB)" % (float(size) / 1073741824)
    return ""


def test_human_size_bounds_and_ties(spark):
    sizes = [0, 1, 1023, 1024, 1025, 1280, 1152, 1408, 1048575, 1048576, 1048577, 1310720, 1073741823, 1073741824,
             1342177280, 5 << 40]
    sizes += [1024 * k // 20 for k in range(20, 400)]
    assert apply(spark, sizes, text.human_size, "long") == [python_size(s) for s in sizes]


def test_megabytes(spark):
    texts = ["16384 kB", "1023 kB", "512 MB", "2 GB", "2 gb", "7 TB", "x", "", None]
    assert apply(spark, texts, text.to_megabytes) == [16, 0, 512, 2048, 2048, None, None, None, None]


def test_sizes_around_tabs(spark):
    lines = ["123\t/", "a\t5\t/", " 77 \t/", "5", "\t/", "1.5\t/", "-3\t/", "99999999999999999999\t/"]
    assert apply(spark, lines, text.size_before_tab) == [123, None, 77, None, None, None, -3, None]
    assert apply(spark, ["/\t12", "/a\tb\t9", "12", "/\t"], text.size_after_tab) == [12, 9, 12, None]


def test_job_ids(spark):
    lines = [
        "x INFO mapreduce.Job: Running job: job_1",
        "x INFO mapred.JobClient: Running job: job_2",
        "x Running job: job_3",
        "mapreduce.Job: Running job",
        "mapreduce.Job: Running job: a Running job: b",
    ]
    assert apply(spark, lines, text.job_id_of_line) == ["job_1", "job_2", None, None, "b"]


def test_lists(spark):
    assert apply(spark, ["a, b\t,,c ", "", " x "], params.split_trim_list) == [["a", "b", "", "c"], [""], ["x"]]


def test_job_specs(spark):
    specs = ["a.jar", "a.jar || in out", "a.jar||in||l1.jar, l2.jar ", "a||b||c||d", "a || ||"]
    got = [(r["path"], r["params"], r["libs"]) for r in apply(spark, specs, params.split_job_spec)]
    assert got == [
        ("a.jar", None, None),
        ("a.jar", "in out", None),
        ("a.jar", "in", ["l1.jar", "l2.jar"]),
        ("a", "b", None),
        ("a", "", []),
    ]


def test_macro_names(spark):
    values = ["${a}/${b.c}/${a}", "$a {b}", "${}", None]
    assert apply(spark, values, params.macro_names) == [["a", "b.c", "a"], [], [""], None]


def test_replacement_takes_text_as_it_is(spark):
    df = spark.createDataFrame([("${a}|${b}|${c}", "$1\\x", None)], "v string, a string, b string")
    known = {"a": F.col("a"), "b": F.col("b")}
    assert df.select(params.replace_macros(F.col("v"), known)).first()[0] == "$1\\x|${b}|${c}"


def test_assignments(spark):
    lists = [["site.xml", "a=1", "b=x=y"], ["a=1", "a=2"], ["f"], ["a="]]
    got = [(r["file"], r["params"]) for r in apply(spark, lists, params.parse_assignments, "array<string>")]
    assert got == [("site.xml", {"a": "1", "b": "x=y"}), (None, {"a": "2"}), ("f", {}), (None, {"a": ""})]


@pytest.mark.parametrize("word,value", [("true", True), (" False", False), ("0", False), ("maybe", None)])
def test_booleans(spark, word, value):
    assert apply(spark, [word], params.is_true) == [value]


def test_routes(spark):
    got = [tuple(r) for r in apply(spark, ["xp.job", "io.sort", "xpx"], params.route_name)]
    assert got == [("xp", "job"), ("engine", "io.sort"), ("engine", "xpx")]
    assert apply(spark, ["ds.class.path", "ds.class", "ds.size"], params.class_property) == ["path", None, None]
