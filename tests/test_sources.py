import json
import os

import pytest

from graphloom.functions import scalars
from graphloom.operators import metrics
from graphloom.sources import files


def test_changed_units(spark, tmp_path):
    (tmp_path / "fs").mkdir()
    for name, t in (("fs/a.o", 2000), ("fs/b.o", 500), ("c.o", 3000)):
        (tmp_path / name).write_bytes(b"x")  # empty files are not scanned
        os.utime(tmp_path / name, (t, t))
    entries = [
        {"directory": "/b", "file": "a.c", "command": "cc -c a.c -o fs/a.o -O2"},
        {"directory": "/b", "file": "b.c", "arguments": ["cc", "-o", "fs/b.o"]},
        {"directory": "/b", "file": "c.c", "arguments": ["cc", "-o", "/work/build/c.o"]},
        {"directory": "/b", "file": "d.c", "command": "cc -c d.c"},
        {"directory": "/b", "file": "e.c", "command": "cc -o missing.o"},
    ]
    (tmp_path / "cc.json").write_text(json.dumps(entries))
    timed = files.object_times(files.compile_commands(spark, str(tmp_path / "cc.json")), files.object_files(spark, str(tmp_path)))
    assert {r["file"]: r["mtime"] for r in timed.collect()} == {"a.c": 2000.0, "b.c": 500.0, "c.c": 3000.0, "d.c": None, "e.c": None}
    out = tmp_path / "out.json"
    assert files.write_compile_commands(files.rebuilt(timed, 1000), str(out)) == 2
    assert json.loads(out.read_text()) == [entries[0], entries[2]]
    assert files.write_compile_commands(files.rebuilt(timed, 9000), str(tmp_path / "none.json")) == 0
    assert not (tmp_path / "none.json").exists()


def test_source_text(spark, tmp_path):
    (tmp_path / "a.c").write_text("one\ntwo()\nthree \nfour\n")
    lines = files.source_lines(spark, str(tmp_path), "a.c")
    assert [r["text"] for r in files.source_range(lines, 1, 2, 1).collect()] == ["one", "two()", "three ", "four"]
    assert files.source_range(lines, 9, 12).count() == 0
    assert files.source_range(lines, -1, 1).count() == 0
    assert [r["text"] for r in files.source_grep(lines, "two", 2).collect()] == ["     2\ttwo()", "     3\tthree"]


def test_evaluation_runs(spark, tmp_path):
    cell = {"model": "m", "tier": "t", "arm": "A", "accuracy": {"recall": 1.0, "precision": 1.0, "f1": 0.5}, "cost": {"tokens_in": 10, "tokens_out": 5, "tool_calls": {"grep": 2, "read": 1}, "wall_seconds": 1.5}}
    (tmp_path / "a.json").write_text(json.dumps(cell))
    (tmp_path / "b.json").write_text(json.dumps(cell | {"error": "stopped"}))
    (tmp_path / "c.json").write_text("{broken")
    row = metrics.medians(metrics.eval_cells(files.eval_runs(spark, str(tmp_path)))).first()
    assert (row["f1"], row["tokens"], row["calls"], row["wall"], row["n"]) == (0.5, 15.0, 3.0, 1.5, 1)


def test_parameters():
    assert [scalars.bounded_int(v, 7, 1, 3) for v in (0, 2, 9, "x", None)] == [1, 2, 3, 7, 7]
    assert scalars.check_prefix("fs/ext4") == "fs/ext4"
    for bad in ("/fs", "fs/", "a//b", "a/../b", "a\\b"):
        with pytest.raises(ValueError):
            scalars.check_prefix(bad)
    assert scalars.check_offset("10") == 10
    with pytest.raises(ValueError):
        scalars.check_offset("-1")
