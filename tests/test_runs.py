"""Batches and single runs from folders with missing files, and their traces."""

import json

import pytest

from evigraph.sources import runs


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))


@pytest.fixture
def batch(tmp_path):
    root = tmp_path / "batch one"
    folder = lambda name: root / "models" / "m" / "s" / name
    listed = [
        {"run_id": "r1", "status": "success", "run_dir": str(folder("rep_1")), "model_id": "m", "scope_id": "s", "repetition": 1, "provider": "p0"},
        {"run_id": "", "status": "success", "run_dir": str(folder("rep_2")) + "/", "scope_id": "s", "repetition": "x", "batch_id": "own"},
        {"status": "failed", "run_dir": str(folder("rep_3"))},
        {"status": "success", "run_dir": str(folder("rep_4"))},
    ]
    write(root / "batch_manifest.json", {"batch_id": "b", "runs": listed})
    write(folder("rep_1") / "run_metadata.json", {"run_id": "other", "provider": "p1", "model": "m1"})
    write(folder("rep_1") / "final_answer.json", {"findings": []})
    write(folder("rep_1") / "tool_observations.jsonl", '{"step": 1}\n\n{"step": 2}\n')
    write(folder("rep_2") / "run_metadata.json", {"run_id": "from metadata", "provider": "p2", "input_scope_path": "/x/scopes/s2/"})
    write(folder("rep_2") / "tool_trace.jsonl", '{"step": 7}\n')
    write(folder("rep_2") / "tool_observations.jsonl", '{"step": 8}\n')
    write(folder("rep_3") / "run_metadata.json", {"run_id": "failed"})
    return root


def test_batch(spark, batch):
    rows = runs.load_batch(spark, str(batch)).orderBy("ord").collect()
    assert [(r["ord"], r["batch_id"], r["run_id"], r["provider"], r["model"], r["repetition"]) for r in rows] == [
        (0, "b", "r1", "p0", "m1", 1), (1, "own", "from metadata", "p2", "", None), (3, "b", "rep_4", "", "", None),
    ]
    assert [(r["trace_path"].rpartition("/")[2], r["trace_exists"], r["final_answer"] is not None) for r in rows] == [
        ("tool_observations.jsonl", True, True), ("tool_trace.jsonl", True, False), ("tool_trace.jsonl", False, False),
    ]
    traced = runs.trace_rows(spark, str(batch), runs.load_batch(spark, str(batch)), "step int").collect()
    assert sorted((r["run_id"], r["line_ord"], r["step"]) for r in traced) == [("from metadata", 0, 7), ("r1", 0, 1), ("r1", 2, 2)]


def test_single_run(spark, batch):
    row = runs.load_run(spark, str(batch / "models" / "m" / "s" / "rep_2")).first()
    assert (row["run_id"], row["model_id"], row["input_scope"], row["repetition"], row["final_answer"]) == ("from metadata", "p2", "s2", None, None)
    with pytest.raises(Exception):
        runs.load_run(spark, str(batch / "models")).collect()


def test_damaged_files_fail(spark, batch):
    write(batch / "models" / "m" / "s" / "rep_2" / "run_metadata.json", "{broken")
    with pytest.raises(Exception):
        runs.load_batch(spark, str(batch)).collect()
    with pytest.raises(Exception):
        runs.load_batch(spark, str(batch / "models")).collect()


def test_folders_are_not_listed(spark, batch):
    """The driver knows the manifest alone: no file of a run is among the files that a plan names."""
    named = [f for f in runs.load_batch(spark, str(batch)).inputFiles() if "/models/" in f]
    loaded = runs.load_batch(spark, str(batch))
    assert named == [] and [f for f in runs.trace_rows(spark, str(batch), loaded, "step int").inputFiles() if "/models/" in f] == []


def test_places_of_folders(spark, batch, tmp_path):
    """Folders outside the batch are not read; a null folder, a byte order mark, line ends and bytes that are no text."""
    outside = tmp_path / "elsewhere" / "rep_1"
    inside = batch / "models" / "rep_9"
    write(outside / "run_metadata.json", {"run_id": "outside"})
    write(inside / "run_metadata.json", {"run_id": "inside"})
    (inside / "tool_trace.jsonl").write_bytes(b'\xef\xbb\xbf{"step": 1, "t": "\xff"}\r\n   \n{"step": 2}')
    listed = [{"status": "success", "run_dir": d} for d in (str(outside), f"{batch}/../elsewhere/rep_1", f"file://{inside}/", None)]
    write(batch / "batch_manifest.json", {"batch_id": "b", "runs": listed})
    loaded = runs.load_batch(spark, str(batch))
    assert [(r["ord"], r["run_id"], r["trace_exists"]) for r in loaded.orderBy("ord").collect()] == [(0, "rep_1", False), (1, "rep_1", False), (2, "inside", True), (3, None, False)]
    traced = runs.trace_rows(spark, str(batch), loaded, "step int, t string").orderBy("line_ord").collect()
    assert [(r["run_id"], r["line_ord"], r["step"], r["t"]) for r in traced] == [("inside", 0, 1, "�"), ("inside", 2, 2, None)]


def test_manifest_of_parts(spark, batch):
    """A manifest that Spark wrote is a folder of parts; the runs are found beside it all the same."""
    document = (batch / "batch_manifest.json").read_text()
    (batch / "batch_manifest.json").unlink()
    write(batch / "batch_manifest.json" / "part-0.json", document)
    loaded = runs.load_batch(spark, str(batch))
    assert [(r["model"], r["trace_exists"]) for r in loaded.orderBy("ord").collect()] == [("m1", True), ("", True), ("", False)]
    assert runs.trace_rows(spark, str(batch), loaded, "step int").count() == 3
