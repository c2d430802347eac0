"""Calls by content: what is sent, what is kept, batches that fail."""

from pathlib import Path

import pytest

from saltern.operators import calls
from saltern.operators.calls import CallTable


def model(log, broken=()):
    """Upper case; every call leaves a file, and a batch with a broken prompt raises."""

    def call(prompts):
        import uuid

        (Path(log) / uuid.uuid4().hex).write_text("\n".join(prompts))
        if set(prompts) & set(broken):
            raise RuntimeError("overloaded")
        return [p.upper() if p != "mute" else None for p in prompts]

    return call


def sent(log):
    return sorted(p for f in Path(log).iterdir() for p in f.read_text().split("\n"))


def test_a_prompt_is_sent_once(spark, tmp_path):
    (log := tmp_path / "log").mkdir()
    it = CallTable(spark, str(tmp_path / "t"), "m1")
    rows = spark.createDataFrame([(k, None if k % 10 == 9 else f"p{k % 30}", "x") for k in range(200)], "id int, `a.b` string, reply string").drop("reply")
    it.run(rows, model(log), batch=4, prompt="a.b", parallel=3)
    assert sent(log) == sorted(f"p{k}" for k in range(30) if k % 10 != 9)
    assert all(len(f.read_text().split("\n")) <= 4 for f in log.iterdir())
    it.run(rows, model(log), batch=4, prompt="a.b")  # nothing to send, nothing committed
    assert len(sent(log)) == 27 and it._stored()[0] == 1
    got = {r["id"]: r["reply"] for r in it.answered(rows, "a.b").collect()}
    assert got == {k: None if k % 10 == 9 else f"P{k % 30}" for k in range(200)}
    CallTable(spark, it.path, "m2").run(rows.limit(1), model(log), prompt="a.b")  # another model has its own replies
    assert len(sent(log)) == 28
    empty = CallTable(spark, str(tmp_path / "e"), "m1")
    empty.run(rows.limit(0), model(log), prompt="a.b")
    assert empty.replies().isEmpty() and empty._stored()[0] == 0


def test_failures_are_rows_and_are_tried_again(spark, tmp_path, monkeypatch):
    (log := tmp_path / "log").mkdir()
    it = CallTable(spark, str(tmp_path / "t"), "m")
    rows = spark.createDataFrame([(p,) for p in ["", "mute", "bad", *(f"p{k}" for k in range(20))]], "prompt string")
    it.run(rows, model(log, ["bad"]), batch=1)
    failed = {r["key"]: (r["tries"], r["error"]) for r in it.failures().collect()}
    assert sorted(failed.values()) == [(1, "RuntimeError: overloaded"), (1, "no reply")] and it.replies().count() == 21
    it.run(rows, model(log), batch=5)
    assert len(sent(log)) == 23 + 2 and it.replies().count() == 22
    assert {r["prompt"]: r["reply"] for r in it.answered(rows).collect()}["bad"] == "BAD"
    it.run(rows, model(log), tries=2)  # given up
    assert len(sent(log)) == 25 and [r["tries"] for r in it.failures().collect()] == [2]
    short = CallTable(spark, str(tmp_path / "s"), "m", "array<float>")
    short.run(rows, lambda prompts: [[1.0, 2.0]] * (len(prompts) - 1), batch=4, parallel=1)
    assert short.replies().isEmpty() and short.failures().count() == 23
    monkeypatch.setattr(calls, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        short.run(rows, lambda prompts: [[float(len(p))] for p in prompts])
    monkeypatch.undo()
    assert short.replies().isEmpty()
    short.run(rows, lambda prompts: [[float(len(p))] for p in prompts])
    assert sorted(r["reply"][0] for r in short.replies().collect()) == sorted(float(len(r["prompt"])) for r in rows.collect())
