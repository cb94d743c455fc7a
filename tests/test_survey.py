"""Survey changes, and the upload log with reruns, bad lines and a run that dies."""

import json

import pytest

from landloom.operators import survey
from landloom.streaming import uploads


def test_changes(spark):
    spec = "id string, x double, y double, status string, name string"
    latest = [("same", 1, 1, "alive", "a"), ("far", 1, 1, "alive", "a"), ("new name", 1, 1, "alive", "a"), ("felled", 1, 1, None, "a"), ("back", 1, 1, "dead", "a"), ("was gone", 1, 1, "removed", "a"), ("unseen", 1, 1, "alive", "a"), ("placed", None, None, None, "a")]
    staged = [("same", 1.0001, 1, "alive", None), ("far", 1, 1.5, "alive", "b"), ("new name", 1, 1, "alive", "b"), ("felled", 9, 1, "Removed", "a"), ("back", 1, 1, "alive", "a"), ("was gone", 2, 1, "dead", "b"), ("first", 0, 0, None, None), ("never", 0, 0, "gone", None), ("placed", 1, 1, None, "a"), (None, 1, 1, None, "a")]
    rows = lambda x: spark.createDataFrame([(i, None if a is None else float(a), None if b is None else float(b), s, n) for i, a, b, s, n in x], spec)
    got = {r.id: (r.change, r.changed) for r in survey.classify(rows(staged + staged[:1]), rows(latest), ["name"]).collect()}
    assert got == {
        "same": ("unchanged", []), "far": ("moved", ["name"]), "new name": ("updated", ["name"]), "felled": ("retired", []), "back": ("created", []), "was gone": ("unchanged", []), "unseen": ("absent", []), "first": ("created", []), "never": ("unchanged", []), "placed": ("moved", []),
    }
    assert survey.classify(rows([]), rows([]), ["name"]).count() == 0


def test_uploads_once_each(spark, tmp_path, monkeypatch):
    log, path, mark = (str(tmp_path / n) for n in ("log", "store", "mark"))
    (tmp_path / "log").mkdir()

    def upload(name, *rows):
        (tmp_path / "log" / f"{name}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))

    def run():
        uploads.ingest_uploads(spark, log, path, mark, files_per_batch=1).awaitTermination(120)

    def state():
        return {r.id: (r.x, r.status, r.name) for r in uploads.store_state(spark, path).collect()}

    assert state() == {}
    upload("1", {"upload": "u1", "id": "a", "x": 1, "y": 1, "name": "oak"}, "{not json", {"upload": "u1", "x": 1}, {"upload": "u1", "id": "b", "x": 2, "y": 2})
    run()
    assert state() == {"a": (1.0, None, "oak"), "b": (2.0, None, None)} and spark.read.parquet(f"{path}/bad").count() == 2
    run()
    assert spark.read.parquet(f"{path}/changes").count() == 2
    upload("2", {"upload": "u2", "id": "a", "x": 5, "y": 1}, {"upload": "u2", "id": "b", "x": 2, "y": 2})
    real = uploads.classify
    monkeypatch.setattr(uploads, "classify", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        run()
    monkeypatch.setattr(uploads, "classify", real)
    upload("3", {"upload": "u3", "id": "b", "x": 2, "y": 2, "status": "removed"})
    run()
    assert state() == {"a": (5.0, None, "oak"), "b": (2.0, "removed", None)}
    changes = sorted((r.batch, r.id, r.change) for r in spark.read.parquet(f"{path}/changes").collect())
    assert changes == [(0, "a", "created"), (0, "b", "created"), (1, "a", "moved"), (2, "b", "retired")]
