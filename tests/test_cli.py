"""Every command of the command line, over one stored collection."""

import io
import json
import shutil

import pytest

from lodestone import cli


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "home").mkdir()

    def call(*argv, code=0):
        assert cli.main([*map(str, argv)], spark) == code
        out = capsys.readouterr()
        return out.out.strip() if code == 0 else out.err.strip()

    return call


def test_commands(run, tmp_path, monkeypatch, capsys):
    run("config", "dimensions=2", "api_key=s3cret")
    assert json.loads(run("config")) == {"dimensions": 2, "quantization": "F32", "metric": "cosine", "api_key": "****"}
    monkeypatch.setenv("LODESTONE_METRIC", "dot")
    (tmp_path / "home" / ".lodestone.json").write_text('{"metric": "euclidean", "note": 1}')
    assert json.loads(run("config"))["metric"] == "dot" and json.loads(run("config"))["note"] == 1
    c = tmp_path / "c"
    run("init", c)
    (tmp_path / "in.jsonl").write_text('{"id":"a","embedding":[1,0],"context":{"v":1,"in":{"k":"x"}}}\n{"id":"b","embedding":[0,1],"context":{"v":2}}\n')
    run("import", c, tmp_path / "in.jsonl", "--format", "jsonl")
    (tmp_path / "more.jsonl").write_text('{"id":"b","embedding":[1,1],"context":{"v":3}}\n{"id":"c","text":"pets and animals"}\n')
    assert json.loads(run("count", c))["count"] == 2
    run("add-many", c, tmp_path / "in.jsonl")
    assert [r["id"] for r in json.loads(run("find", c, "--sort", '{"v":-1}'))] == ["b", "a"]
    shown = run("find", c, "--format", "table", "--limit", 1)
    assert "context.in.k" in shown
    assert json.loads(run("query", c, "1,0", "--top-k", 1))["id"] == "a"
    assert json.loads(run("get", c, "a"))["context"]["v"] == 1
    (tmp_path / "bad.jsonl").write_text('{"id":"a","embedding":[1,2]}\n\n{x\n')
    assert "Invalid JSON on line 2" in run("import", c, tmp_path / "bad.jsonl", "--format", "jsonl", code=1)
    assert "numbers" in run("query", c, "1,x", code=1)
    assert json.loads(run("stats", c))["entry_count"] == 2
    assert json.loads(run("distinct", c, "v", "--format", "jsonl").splitlines()[0])["value"] == "1"
    run("export", c, tmp_path / "out", "--format", "csv")
    head = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()[0]
    assert head.endswith("context.in.k,context.v")
    assert json.loads(run("run", c, "db.count({context.v: 1})"))["count"] == 1
    monkeypatch.setattr("sys.stdin", io.StringIO('db.count({})\ndb.find(\ndb.delete("a")\n\ndb.count({});\nexit\ndb.count({})\n'))
    lines = run("repl", c, "--format", "jsonl").splitlines()
    assert [json.loads(x)["count"] for x in (lines[0], lines[2])] == [2, 1] and lines[1] == "ok" and len(lines) == 3
    run("delete", c, "b")
    assert json.loads(run("count", c))["count"] == 0
    shutil.move(c, tmp_path / "c.last")  # a swap that was cut
    assert json.loads(run("count", c))["count"] == 0
    assert "nothing is pending" in run("flush", c) and "repl" in run("completions") and len(json.loads(run("embed", "some", "text"))) == 2
