"""A working copy from end to end: history, comparison, command line, report, and a stream."""

import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators.filters import ReportFilter
from plumbline.plans import cli, report
from plumbline.plans.scan import Scan
from plumbline.sources import files, history
from plumbline.streaming.churn import daily_counts

DEEP = "if (a > 0) { " * 7 + "go();" + " }" * 7


def git(folder, *args, when="2024-01-05T00:00:00Z"):
    who = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "HOME": str(folder), "PATH": "/usr/bin:/bin:/usr/local/bin"}
    return subprocess.run(["git", *args], cwd=folder, check=True, capture_output=True, text=True, env=who).stdout


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    """Two commits; then a changed method, a new file that isn't committed, and history of a folder that isn't parsed."""
    root = tmp_path_factory.mktemp("shop")
    (root / "src").mkdir()
    (root / "target").mkdir()
    (root / "pom.xml").write_text("<project/>")
    (root / "target" / "Made.java").write_text("class Made {\n}\n")
    (root / "src" / "Shop.java").write_text("package s;\npublic class Shop {\n  Cart cart;\n  public static void main(String[] a) { new Cart(); }\n}\n")
    (root / "src" / "Cart.java").write_text("package s;\npublic class Cart {\n  Shop shop;\n  public int hard(int a) {\n    " + DEEP + "\n    return a;\n  }\n  public void idle() {}\n}\n")
    (root / "src" / "Lost.java").write_text("package s;\nclass Lost { }\n")
    git(root, "init", "-q", "-b", "main")
    git(root, "add", "-A", "-f")
    git(root, "commit", "-q", "-m", "one")
    cart = root / "src" / "Cart.java"
    cart.write_text(cart.read_text().replace("return a;", "return a + 1;"))
    git(root, "commit", "-q", "-a", "-m", "two", when="2024-01-09T00:00:00Z")
    (root / "src" / "New.java").write_text("package s;\nclass New { }\n")
    return root


def test_history_and_lines_outside_the_sources(spark, project, monkeypatch):
    monkeypatch.setattr(history, "PER_JOB", 1)  # a task for each commit
    log = history.history(spark, project)
    got = {(r.path, r.ts, r.added, r.deleted) for r in log.collect()}
    assert {("src/Cart.java", 1704758400, 1, 1), ("src/Lost.java", 1704412800, 2, 0), ("target/Made.java", 1704412800, 2, 0)} <= got and len(got) == 5
    scan = Scan(files.source_files(spark, str(project)), log, Config(as_of=1704758400), root=str(project))
    rows = {r.file: r for r in scan.hotspots().collect()}
    assert (rows["target/Made.java"].loc, rows["target/Made.java"].score, rows["src/Cart.java"].score, rows["src/Cart.java"].loc) == (3, 0.0, 100.0, 10)


def test_comparison(spark, project, tmp_path):
    ranges, added = history.changes(spark, project, "HEAD~1")
    assert {(r.path, r.start, r.end) for r in ranges.collect()} == {("src/Cart.java", 6, 6), ("src/New.java", 1, 2147483647)}
    assert [r.path for r in added.collect()] == ["src/New.java"]
    for ref, error in (("nowhere", ValueError), ("-x", ValueError)):
        with pytest.raises(error):
            history.changes(spark, project, ref)
    with pytest.raises(RuntimeError, match="not a repository"):
        history.changes(spark, tmp_path, "main")
    with pytest.raises(RuntimeError):
        history.history(spark, tmp_path)


def run(capsys, project, *args):
    code = cli.main([*args, "--root", str(project)])
    said = capsys.readouterr()
    return code, said.out, said.err


def test_command_line(spark, project, tmp_path, capsys):
    code, out, _ = run(capsys, project, "complexity", "--fail-on", "complexity", "--max-cognitive", "10")
    assert code == 1 and "complexity: 1" in out and "hard" in out and "failed: complexity: 1 complex function above the limit" in out
    assert "Cyclomatic: paths" in out and "Cyclomatic: paths" not in run(capsys, project, "complexity", "--no-legend")[1]
    code, out, _ = run(capsys, project, "unused-files", "--fail-on", "unused-files", "--skip-pattern", "lost.java, new*")
    assert code == 1 and "unused-files: 2" in out  # patterns are in small letters, paths aren't
    code, out, _ = run(capsys, project, "unused-files", "--compare-against", "HEAD")
    assert code == 0 and "unused-files: 1" in out and "New.java" in out and "Lost.java" not in out
    code, out, err = run(capsys, project, "circular", "--compare-against", "nowhere")
    assert code == 0 and "no comparison" in err and "circular: 1" in out
    code, out, _ = run(capsys, project, "hotspots", "--as-of", "1704758400", "--fail-on", "hotspots", "--max-hotspot-score", "50", "--top", "1")
    assert code == 1 and "Cart.java" in out and "Shop.java" not in out and "high" in out
    assert run(capsys, project, "bugs")[:2] == (0, "bugs: not available; bug findings come from other tools\n")
    assert run(capsys, tmp_path, "circular")[0] == 2
    assert cli.main(["explain", "dead", "files"]) == 0 and "Unused files" in capsys.readouterr().out
    assert cli.main(["explain", "nothing"]) == 0 and "clone-families" in capsys.readouterr().out


def test_whole_report(spark, project):
    log = history.history(spark, project)
    scan = Scan(files.source_files(spark, str(project)), log, Config(as_of=1704758400, min_tokens=5, min_lines=1), root=str(project))
    text = report.render(scan)
    for name in ("hotspots", "complexity", "large-functions", "circular", "unused-files", "unused-exports", "duplicates", "families", "targets"):
        assert f"{name}: " in text
    assert {r.name for r in scan.top("unused-exports").collect()} == {"hard", "idle"}
    assert [r.files for r in scan.top("circular").collect()] == [["src/Cart.java", "src/Shop.java"]]


def test_orders_of_sections(spark, project):
    class Fixed(Scan):
        rows: dict = {}

        def section(self, name):
            return spark.createDataFrame(*self.rows[name])

    scan = Fixed(files.source_files(spark, str(project)), config=Config(top=3))
    scan.rows = {
        "circular": ([(["c", "d"], 2, False), (["a", "b", "c"], 3, True), (["a", "b"], 2, False)], "files array<string>, size long, cross_package boolean"),
        "unused-files": ([("b",), ("c",), ("a",), ("d",)], "path string"),
        "duplicates": ([(1, "b", 4, 9, 50, 6), (2, "a", 1, 9, 70, 9), (1, "a", 2, 7, 50, 6)], "group_id long, path string, start_line int, end_line int, token_count int, line_count int"),
        "families": ([(["b"], 2, 40, ""), (["a"], 3, 40, ""), (["c"], 2, 90, "")], "files array<string>, group_count long, total_lines long, suggestion string"),
        "targets": ([("b", 5.0, 2.5), ("a", 5.0, 2.5), ("c", 9.0, 2.5), ("d", 1.0, 3.0)], "path string, priority double, efficiency double"),
        "deps": ([("unused", "x:y", 9), ("undeclared", "a:b", 2)], "kind string, coord string, line_no long"),
        "large-functions": ([("a", "f", 1, 70), ("b", "g", 2, 90), ("a", "h", 9, 65)], "path string, name string, line int, line_count int"),
    }
    got = {name: [r[0] for r in scan.top(name).collect()] for name in scan.rows}
    assert got["circular"] == [["a", "b"], ["c", "d"], ["a", "b", "c"]] and got["unused-files"] == ["a", "b", "c"]
    assert got["duplicates"] == [2, 1, 1] and got["families"] == [["c"], ["a"], ["b"]] and got["targets"] == ["d", "c", "a"]
    assert got["deps"] == ["undeclared", "unused"]
    assert [r.name for r in scan.top("large-functions").collect()] == ["g", "f", "h"]  # of the best file first


def test_dependencies_show_with_a_changed_build_file(spark):
    rows = spark.createDataFrame([("unused", "a:b", 1)], "kind string, coord string, line_no long")
    changed = lambda p: spark.createDataFrame([(p, 1, 1)], "path string, start int, end int")
    added = spark.createDataFrame([("x/pom.xml",)], "path string")
    assert ReportFilter().dependencies(rows).count() == 1
    assert ReportFilter([], changed("A.java")).dependencies(rows).count() == 0
    assert ReportFilter([], changed("x/pom.xml")).dependencies(rows).count() == 1
    assert ReportFilter([], changed("A.java"), added).dependencies(rows).count() == 1


def test_a_stream_counts_what_a_batch_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = daily_counts(stream, "user_id", "ts").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = spark.table("daily"), daily_counts(events, "user_id", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_a_tree_is_split_by_folders(tmp_path):
    for i in range(5):
        for j in range(3):
            folder = tmp_path / f"m{i}" / f"p{j}" / "deep"
            folder.mkdir(parents=True)
            (folder / "A.java").write_text("")
            (folder / ".java").write_text("")
        (tmp_path / f"m{i}" / "B.java").write_text("")
    (tmp_path / "m0" / "build").mkdir()
    (tmp_path / "m0" / "build" / "C.java").write_text("")
    for least in (1, 2, 6, 1000):
        found, folders = files.split_tree(str(tmp_path), least=least)
        every = [*found, *files.walk_sources(folders)]
        assert len(every) == len(set(every)) == 20 and not any("build" in p for p in every)
    assert len(files.split_tree(str(tmp_path), least=6)[1]) == 15
    assert files.split_tree(str(tmp_path / "m0" / "build")) == ([], [])
