"""The command line runs end to end on small files and reports what the operators return."""

import json

import pytest

from graphs import TWO_GRAPHS, membership_of
from linkfold.__main__ import main
from linkfold.operators.components import connected_components


def test_components_cli(spark, tmp_path, capsys):
    src = tmp_path / "edges.tsv"
    src.write_text("".join(f"{a}\t{b}\n" for a, b in TWO_GRAPHS))
    out = tmp_path / "out"
    report = main(["components", "--input", str(src), "--output", str(out), "--top", "3"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == report
    want = connected_components(spark.createDataFrame(TWO_GRAPHS, "src long, dst long"))
    assert report["trace"] == [list(t) for t in want.trace]
    assert report["components"] == 2
    assert (report["input_rows"], report["rejected_rows"]) == (17, 0) and report["input_partitions"] >= 1
    assert report["top"] == [[1, 8], [9, 5]]
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())
    assert got == membership_of(TWO_GRAPHS)


def test_components_cli_contracts_and_resumes(spark, tmp_path):
    src = tmp_path / "edges.tsv"
    src.write_text("".join(f"{a}\t{b}\n" for a, b in TWO_GRAPHS))
    args = ["components", "--input", str(src), "--output", str(tmp_path / "out")]
    for more in (["--strategy", "contract"], ["--resume", "cli-run"]):
        report = main([*args, *more])
        assert report["components"] == 2 and report["top"] == [[1, 8], [9, 5]]
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == membership_of(TWO_GRAPHS)


def test_components_cli_reports_what_it_drops(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("lead\n1\t2\n2\tx\n3\n4\t5\n")
    args = ["components", "--input", str(tmp_path / "e.tsv"), "--output", str(tmp_path / "o"), "--skip-lines", "1"]
    with pytest.raises(Exception, match="edge row"):
        main(args)
    report = main([*args, "--on-bad", "drop", "--partitions", "2"])
    assert (report["input_rows"], report["rejected_rows"], report["components"]) == (4, 2, 2)


def test_kmeans_cli(spark, tmp_path):
    pts = [(0.0, 0.0, "a"), (0.2, 0.1, "a"), (0.1, 0.3, "a"),
           (5.0, 5.0, "b"), (5.2, 4.9, "b"), (4.8, 5.1, "b")]
    src = tmp_path / "points.csv"
    src.write_text("".join(f"{x},{y},{lab}\n" for x, y, lab in pts))
    out = tmp_path / "out"
    report = main(["kmeans", "--input", str(src), "--output", str(out), "--k", "2",
                   "--features", "2", "--format", "csv"])
    assert report["switches"][-1] == 0 and len(report["centers"]) == 2
    rows = spark.read.schema("id long, cid int, dist double, f0 double, f1 double, label string").csv(str(out)).collect()
    assert report["converged"] and sorted((r.f0, r.f1, r.label) for r in rows) == sorted(pts)
    assert sorted(r.id for r in rows) == list(range(len(pts)))
    by_label = {}
    for r in rows:
        by_label.setdefault(r.label, set()).add(r.cid)
    assert all(len(c) == 1 for c in by_label.values()) and by_label["a"] != by_label["b"]


def test_kmeans_cli_bad_rows(spark, tmp_path):
    src = tmp_path / "points.csv"
    src.write_text("0,0,a\n0,1,a\n9,9,b\n9,none,b\n9,8\n8,9,b\n")
    args = ["kmeans", "--input", str(src), "--k", "2", "--features", "2"]
    with pytest.raises(Exception, match="vector row"):
        main([*args, "--output", str(tmp_path / "fail")])
    report = main([*args, "--output", str(tmp_path / "drop"), "--on-bad", "drop"])
    assert (report["input_rows"], report["rejected_rows"]) == (6, 2)
    assert spark.read.parquet(str(tmp_path / "drop")).count() == 4
