import pytest
from pyspark.sql import functions as F

from vettica.operators import sinks
from vettica.operators.secrets import scan_secrets
from vettica.plans.queries import FINDING_COLUMNS, with_stand_in_scores
from vettica.plans.cascade import cascade, incremental_scan
from vettica.sources import corpus as corpora
from vettica.sources.tree import load_tree
from vettica.streaming.scan import read_corpus_stream, start_scan

PATHS = {
    "src/a.c": True,
    ".env": True,
    "pkg/__init__.py": True,
    "_private/.hidden": True,
    "./x.c": True,
    "../x.c": True,
    ".git/config": False,
    "a/.hid/b/x.c": False,
    "node_modules/x.c": False,
    "a/venv/x.c": False,
    "venvs/x.c": True,
    "__pycache__/x.pyc": False,
    "venv": True,
}


def test_skipped_directories(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    kept = {r.path for r in corpora.prune_dirs(rows).collect()}
    assert kept == {path for path, keep in PATHS.items() if keep}


def test_size_and_binary_limits(spark):
    limit = corpora.MAX_FILE_BYTES
    rows = spark.createDataFrame(
        [
            ("fits", bytearray(b"x"), limit),
            ("big", bytearray(b"x"), limit + 1),
            ("nul at the end of the sniff", bytearray(b"a" * 8191 + b"\0"), 8192),
            ("nul after the sniff", bytearray(b"a" * 8192 + b"\0"), 8193),
            ("unreadable", None, None),
        ],
        "path string, content binary, length bigint",
    )
    kept = {r.path for r in corpora.select_scannable(rows).collect()}
    assert kept == {"fits", "nul after the sniff"}
    skipped = {r.reason: (r.files, r.bytes) for r in corpora.skip_report(rows).collect()}
    assert skipped == {
        "too large": (1, limit + 1),
        "suspected binary": (1, 8192),
        "unreadable": (1, None),
    }


def test_tree_is_read_whole(spark, tmp_path):
    files = {
        ".env": b"token = 'abcdefghij'\n",
        "pkg/__init__.py": b"import os\n",
        "pkg/_deep/er/and/er/x.c": b"int f() { gets(a); }\n\xff",
        "node_modules/skip.c": b"gets(a);",
        ".git/skip.c": b"gets(a);",
        "a/venv/skip.c": b"gets(a);",
        "empty.py": b"",
    }
    for name, content in files.items():
        file = tmp_path / "tree" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    (tmp_path / "tree" / "link.c").symlink_to(tmp_path / "tree" / "empty.py")
    (tmp_path / "tree" / "big.bin").write_bytes(b"x" * (corpora.MAX_FILE_BYTES + 1))
    root = str(tmp_path / "tree")
    rows = {r.path[len(root) + 1 :]: r for r in load_tree(spark, root, 4, max_bytes=corpora.MAX_FILE_BYTES).collect()}
    expected = {n for n in files if "skip" not in n} | {"big.bin"}
    assert set(rows) == expected
    for name in expected - {"big.bin"}:
        assert bytes(rows[name].content) == files[name] and rows[name].length == len(files[name])
    assert rows["big.bin"].content is None and rows["big.bin"].length > corpora.MAX_FILE_BYTES
    (one,) = load_tree(spark, f"{root}/.env", 2).collect()
    assert bytes(one.content) == files[".env"]


def test_changed_files(spark):
    old = spark.createDataFrame([("file1.c", "a"), ("file3.c", "b"), ("gone.c", "c")], "path string, hash string")
    new = spark.createDataFrame([("file1.c", "A"), ("file3.c", "b"), ("file2.c", "d")], "path string, hash string")
    found = {(r.path, r.change) for r in corpora.changed_files(old, new).collect()}
    assert found == {("file1.c", "modified"), ("file2.c", "added")}


@pytest.fixture
def files(corpus):
    return corpus(
        {f"d{i}/{n}": t for i in range(5) for n, t in {
            "a.c": "int f(char *s) {\n\tgets(s);\n\tsystem(s);\n}\n",
            "b.py": "def g(q):\n    eval(q)\n",
            "k.env": "token = 'abcdefghij'\n",
        }.items()}
    )


def scan(rows):
    return cascade(rows, with_stand_in_scores)


def test_stream_finds_what_the_batch_finds(spark, files, tmp_path):
    inbox, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    files.filter("path < 'd2'").write.parquet(inbox)

    def run():
        query = start_scan(scan, read_corpus_stream(spark, inbox, 1), target, "scan", log)
        query.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(target).select(*FINDING_COLUMNS).collect()))

    def batch(rows):
        return sorted(map(tuple, scan(rows).select(*FINDING_COLUMNS).collect()))

    assert run() == batch(files.filter("path < 'd2'"))
    files.filter("path >= 'd2'").write.mode("append").parquet(inbox)
    assert run() == batch(files)
    assert run() == batch(files)


def test_incremental_scan_covers_changes_only(spark, files):
    changed = spark.createDataFrame([("d1/a.c", "modified"), ("d3/k.env", "added")], "path string, change string")
    rows = incremental_scan(files, changed, with_stand_in_scores).collect()
    assert {r.path for r in rows} <= {"d1/a.c", "d3/k.env"}
    assert any(r.layer == 1 for r in rows)


def test_changed_files_of_any_directory_are_read(spark, tmp_path):
    """Size and content decide about a changed file; its directory does not."""
    code = b"def f(q):\n    eval(q)\n"
    rows = [
        (".github/x.py", code, 23),
        ("venv/y.py", code, 23),
        ("src/same.py", code, 23),
        ("src/large.py", code, corpora.MAX_FILE_BYTES + 1),
        ("src/binary.py", b"\0" + code, 24),
        ("src/gone.py", None, None),
    ]
    raw = spark.createDataFrame(rows, "path string, content binary, length long")
    paths = [(path, "modified") for path, *_ in rows if path != "src/same.py"] + [("src/deleted.py", "added")]
    changed = spark.createDataFrame(paths, "path string, change string")
    direct = incremental_scan(raw, changed, with_stand_in_scores)
    landed = incremental_scan(raw, changed, with_stand_in_scores, str(tmp_path / "changed"))
    assert sorted(map(str, direct.collect())) == sorted(map(str, landed.collect()))
    assert sorted({r.path for r in landed.collect()}) == [".github/x.py", "venv/y.py"]
    assert set(landed.inputFiles()) and all("/changed/" in name for name in landed.inputFiles())


def test_incremental_scan_is_compiled(spark, files, tmp_path):
    """Join and scan are separate stages: no join is left in the plan of the scan."""
    changed = spark.createDataFrame([("d1/a.c", "modified")], "path string, change string")
    rows = incremental_scan(files, changed, with_stand_in_scores, str(tmp_path / "changed"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_plans_do_not_shuffle_files(files):
    """Scans are map stages; nothing is exchanged, collected or run in Python."""
    for frame in (scan(files), scan_secrets(files)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for operator in ("Exchange", "CartesianProduct", "BroadcastNestedLoop", "Python", "Window"):
            assert operator not in plan


def test_files_are_scanned_once(files):
    """No rule of the optimizer repeats the scan of a file in a filter."""
    for frame in (sinks.function_spans(files), sinks.call_sites(files), sinks.sink_candidates(files)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in plan.split("\n") if "WHEN lang" in line and "aggregate(" in line]
        assert len(scans) == 1


def test_filters_reach_the_scan(spark, files, tmp_path):
    place = str(tmp_path / "t")
    files.withColumn("length", F.length("text").cast("bigint")).withColumn(
        "content", F.col("text").cast("binary")
    ).write.parquet(place)
    plan = corpora.filter_size(corpora.load_corpus(spark, place)).select("path")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5242880)" in text
    assert "ReadSchema: struct<path:string,length:bigint>" in text


def test_directories_of_the_root_do_not_count(spark, tmp_path):
    root = tmp_path / ".work" / "venv" / "repo"
    for name in ("src/a.c", ".git/b.c", "src/venv/c.c"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("int x;")
    loaded = load_tree(spark, str(root), 2)
    kept = corpora.select_scannable(loaded, str(root)).collect()
    assert [r.path for r in kept] == [f"{root}/src/a.c"]
    assert kept[0].content == b"int x;"


def test_limits_are_arguments(spark):
    rows = spark.createDataFrame(
        [("a", b"xxxx\0", 5), ("b", b"\0", 1), ("c", None, None)], "path string, content binary, length long"
    )
    assert [r.path for r in corpora.select_scannable(rows, max_bytes=9, sniffed_bytes=4).collect()] == ["a"]
    report = {r.reason: r.files for r in corpora.skip_report(rows, max_bytes=4).collect()}
    assert report == {"too large": 1, "suspected binary": 1, "unreadable": 1}
