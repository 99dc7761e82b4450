"""Places of lines and records in files that are read in many splits."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import evaluate
from evigraph.sources import lines, tables


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(1)
    texts = {f"{c}.txt": [f"{c}{i} " + "x" * rng.randrange(40) if rng.random() < 0.9 else "" for i in range(n)] for c, n in (("a", 400), ("b", 1), ("d", 90))}
    for name, found in texts.items():
        (tmp_path / name).write_text("\n".join(found) + "\n")
    (tmp_path / "c.txt").write_text("")
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 5
    got = sorted((r["file_ord"], r["line_ord"], r["ord"], r["value"]) for r in lines.numbered_lines(spark, str(tmp_path)).collect())
    flat = [(f, i, v) for f, name in enumerate(sorted(texts)) for i, v in enumerate(texts[name])]
    assert got == [(f, i, n, v) for n, (f, i, v) in enumerate(flat)]


def test_csv_cells_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    cell = lambda: "".join(rng.choice(['"', "\n", ",", "\r\n", "a", "bc", " ", "é"]) for _ in range(rng.choice([0, 3, 9, 60])))
    want, place = [], []
    for number, name in enumerate(("one.csv", "two.csv")):
        rows = [(str(i), cell(), cell()) for i in range(120)]
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\r\n")
        writer.writerow(["k", "left", "right"])
        for row in rows:
            place.append((number, out.getvalue().count("\n")))
            writer.writerow(row)
        (tmp_path / name).write_bytes(("﻿" if number else "").encode() + out.getvalue().encode())
        want += [(r[2], r[0]) for r in rows]
    got = tables.read_csv_ordered(spark, str(tmp_path), ["right", "k"]).orderBy("ord").collect()
    assert [(r["right"], r["k"]) for r in got] == want
    assert [(r["file_ord"], r["line_ord"]) for r in got] == place


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1\n\n2,3\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), ["y", "x"]).collect()] == [("", "1"), ("3", "2")]
    with pytest.raises(ValueError, match="no column z"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), ["z"])
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError, match="disagree"):
        tables.read_csv(spark, str(tmp_path), ["x"])


def test_json_lines_in_order(spark, tmp_path, small_splits):
    rows = [{"case_id": f"c{i % 7}", "v": i} for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    (tmp_path / "b.jsonl").write_text('﻿{"case_id": "c0", "v": -1}\n')
    found = tables.read_jsonl_ordered(spark, str(tmp_path), "case_id string, v int")
    last = {r["case_id"]: r["v"] for r in tables.last_per_case(found, F.col("case_id"), F.col("ord")).collect()}
    assert last == {"c0": -1, **{f"c{i}": max(r["v"] for r in rows if r["case_id"] == f"c{i}") for i in range(1, 7)}}
    (tmp_path / "c.jsonl").write_text('[1]\n{"case_id": "c1", "v": 9}\n')
    with pytest.raises(Exception, match="no JSON object"):
        tables.read_jsonl_ordered(spark, str(tmp_path), "case_id string, v int").collect()
    assert tables.read_jsonl_ordered(spark, str(tmp_path), "case_id string, v int", strict=False).count() == 202


def test_order_of_files_decides(spark, tmp_path, small_splits):
    """Status rows, duplicates and ground truth take their order from the files that hold them."""
    (tmp_path / "log").mkdir()
    log = [{"run_id": f"r{i % 5}", "status": "failed" if i < 95 else "success"} for i in range(100)]
    (tmp_path / "log" / "status.jsonl").write_text("".join(json.dumps(r) + "\n" for r in log))
    status = tables.read_jsonl_ordered(spark, str(tmp_path / "log"), "run_id string, status string")
    assert {r["status"] for r in evaluate.latest_status(status, ["run_id"]).collect()} == {"success"}

    head = "finding_uid,model_family,method_name,input_scope,repetition,matched_case_id,detection_match,review_notes\n"
    (tmp_path / "review").mkdir()
    (tmp_path / "review" / "a.csv").write_text(head + "".join(f'u{i},m,p,s,1,C{i % 2},TP,"two\nlines"\n' for i in range(60)))
    columns = head.strip().split(",")
    review = tables.read_csv_ordered(spark, str(tmp_path / "review"), columns)
    marked = evaluate.mark_duplicates(review)
    assert sorted(r["finding_uid"] for r in marked.filter("detection_match = 'TP'").collect()) == ["u0", "u1"]

    for name, text in {
        "mapping": "expected_case_id,benchmark_id,input_scope,reason,case_visibility\nC1,b,first,why,visible\nC1,b,second,why,visible\n",
        "task": "case_id,vulnerable_behavior_summary,relevance_reason,official_description,notes\nC1,old,,,\nC1,new,,,\n",
        "official": "case_id,official_description\nC1,o1\nC1,o2\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    read = lambda name, columns: tables.read_csv_ordered(spark, str(tmp_path / f"{name}.csv"), columns).drop("file_ord", "line_ord")
    mapping = read("mapping", ["expected_case_id", "benchmark_id", "input_scope", "reason", "case_visibility"])
    task = read("task", ["case_id", "vulnerable_behavior_summary", "relevance_reason", "official_description", "notes"])
    schema = "case_id string, files array<string>, modules array<string>, hit_summary string, notes string, official_description string, trace array<struct<file:string,module:string,signal_or_register:string>>"
    (tmp_path / "evidence.jsonl").write_text('{"case_id": "C1", "hit_summary": "one"}\n{"case_id": "C1", "hit_summary": "two"}\n')
    evidence = tables.read_jsonl_ordered(spark, str(tmp_path / "evidence.jsonl"), schema).drop("file_ord", "line_ord")
    row = evaluate.gt_assembly(mapping, task, read("official", ["case_id", "official_description"]), evidence, {}).first()
    assert (row["input_scope"], row["case_description"], row["official_description"], row["gt_evidence_notes"]) == ("first", "new", "o2", "two")
