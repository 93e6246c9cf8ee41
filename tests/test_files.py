"""Files, streams and the command line."""

from __future__ import annotations

import json

import pytest

from mnemolith import __main__ as cli
from mnemolith.operators.rules import ViolationError
from mnemolith.sources import jsonio
from mnemolith.streaming import sessions
from tests.helpers import rows


def test_jsonl(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"id": "a"}\n\n  \n{"id": "b", "v": [1]}\n')
    assert rows(jsonio.read_bundle(spark, str(path)), "pos", "doc") == [(1, '{"id": "a"}'), (4, '{"id": "b", "v": [1]}')]
    path.write_text('{"id": "a"}\n[1]\noops\n')
    with pytest.raises(ValueError, match="line 2"):
        jsonio.read_bundle(spark, str(path))
    assert jsonio.read_bundle(spark, str(path), strict=False).count() == 1
    path.write_text("")
    assert jsonio.read_bundle(spark, str(path)).count() == 0


def test_json(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text('[{"id": "a"}, 3, {"id": "b"}, "x"]')
    assert rows(jsonio.read_bundle(spark, str(path)), "pos", "doc") == [(0, '{"id":"a"}'), (2, '{"id":"b"}')]
    path.write_text('{"id": "one"}')
    assert jsonio.read_bundle(spark, str(path)).count() == 1
    for bad in ("3", "{oops"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            jsonio.read_bundle(spark, str(path))
    assert jsonio.sniff("x", " [1]") == "json" and jsonio.sniff("x", "") == jsonio.sniff("x", "a") == "jsonl"


def test_validated_lines(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text('{"id": "a"}\n\n{"id": 1}\nno\n')
    schema = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}}}
    assert [r[0] for r in rows(jsonio.validate_jsonl(spark, str(path), schema))] == [2, 3, 4]
    assert jsonio.validated_jsonl(spark, str(path), schema).count() == 4
    with pytest.raises(ViolationError, match="line 2"):
        jsonio.validate_jsonl(spark, str(path), schema, raise_on_error=True)
    big = tmp_path / "big.jsonl"
    big.write_text("".join(f'{{"n": {i}}}\n' for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = jsonio.numbered_lines(spark, str(big))
        assert lines.rdd.getNumPartitions() >= 1 and all(json.loads(r.text)["n"] == r.line for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_import_and_write(spark, tmp_path):
    data = [(1, "fact", "old", "2025-01-01", "chat"), (1, "fact", "new", "2025-01-02", "chat"), (2, "preference", "tea", "2025-01-01", "chat")]
    made = jsonio.import_memories(spark.createDataFrame(data, "id long, kind string, payload string, created_at string, source string")).cache()
    assert made.count() == 10 and made.where("plane = 'ledger'").count() == 2
    span = json.loads(made.where("plane = 'evidence' and pos = 1").first().doc)
    assert span["text_excerpt"] == "new" and made.where(f"id = '{span['source_id']}'").count() == 1
    jsonio.write_planes(made, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "plane=ledger")).count() == 2


def test_latest_turns_and_merge(spark):
    turns = spark.createDataFrame([("a", i, "x") for i in range(9)] + [("b", 1, "y"), (None, 1, "z")], "s string, t int, _extra string")
    assert rows(sessions.latest_turns(turns, session="s", turn="t", keep=2), "s", "t") == [("a", 7), ("a", 8), ("b", 1)]
    with pytest.raises(ValueError):
        sessions.latest_turns(turns, session="s", turn="t", keep=0)
    both = spark.createDataFrame([(0, 1, 5, "a", "first"), (1, 0, 0, "a", "second"), (0, 0, 0, None, "none")], "bundle_ix int, plane_ord int, pos int, id string, doc string")
    assert rows(sessions.merged(both)) == [("a", "first")]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "session string, turn long, text string"
    (folder / "1.json").write_text("".join(json.dumps({"session": "a", "turn": t, "text": str(t)}) + "\n" for t in (3, 1, 2)))
    (folder / "2.json").write_text(json.dumps({"session": "a", "turn": 5, "text": "5"}) + "\n" + json.dumps({"session": None, "turn": 1, "text": ""}) + "\n")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    run = sessions.session_stream(source, session="session", turn="turn", text="text", keep=2).writeStream.outputMode("update").format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(2, "2"), (3, "3"), (5, "5")} <= {(r.turn, r.text) for r in spark.table("turns").collect()}
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.jsonl").write_text('{"id": "a"}\nno\n')
    run = sessions.validated_stream(spark, str(lines), {"required": ["id"]}).writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(len(r.errors) for r in spark.table("checked").collect()) == [0, 1]


def test_command_line(spark, tmp_path, capsys):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"id": "1", "v": 1}\n{"id": "2"}\n')
    b.write_text('{"id": "1", "v": 2}\n{"id": "3"}\n')
    run = lambda *words: (cli.main([*map(str, words), "--json"]), json.loads(capsys.readouterr().out))
    code, out = run("diff", a, b)
    assert code == 1 and out["counts"] == {"added": 1, "removed": 1, "changed": 1, "unchanged": 0}
    assert run("diff", a, a)[0] == 0
    code, out = run("merge", a, b, "--out", tmp_path / "merged")
    assert (code, out["records"], out["conflicts"]) == (0, 3, ["1"])
    assert len(run("fingerprint", a)[1]["fingerprint"]) == 64
    assert run("hygiene", a, "--now", "2025-01-01T00:00:00Z")[1]["counts"]["records"] == 2
    assert run("validate", a, "--schema", "evidence_span", "--jsonl")[0] == 1
    assert cli.main(["merge", str(a), str(b), "--prefer", "raise"]) == 2
    assert cli.main(["--json", "fingerprint", str(tmp_path / "none.jsonl")]) == 2


def test_sqlite(spark, tmp_path):
    import sqlite3

    from mnemolith.sources import sqlite

    path = tmp_path / "m.db"
    with sqlite3.connect(path) as db:
        db.execute("create table memory (id integer, kind text, payload text, created_at text, source text)")
        db.executemany("insert into memory values (?, 'fact', ?, '2025', 'chat')", [(i * 7, f"p{i}") for i in range(50)] + [(None, "keyless")])
        db.execute("create table none (id integer, n real)")
    sqlite.register(spark)
    read = lambda **options: spark.read.format("sqlite_table").options(path=str(path), **options)
    for parts in (1, 3, 400):
        got = read(partitions=parts).load()
        assert sorted(r.payload for r in got.collect()) == sorted([f"p{i}" for i in range(50)] + ["keyless"])
    assert read(table="none").schema("n double").load().count() == 0
    assert jsonio.import_memories(read().load().where("id is not null")).count() == 250
    with pytest.raises(Exception, match="plain name"):
        read(table="x; drop").load().count()
