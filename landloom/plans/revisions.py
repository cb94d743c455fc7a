"""Plan revisions as append-only tables, with heads that move by compare-and-set.

``revisions`` is a Parquet table of edits by revision. A head is a numbered marker file per plan; a commit
creates the next number and fails if someone else has, which Hadoop file systems decide atomically.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from landloom.operators.filters import QueryError

from . import edits as E

EDIT = "revision_id string, plan_id string, parent string, content_hash string, edit_id string, ordinal long, kind string, x double, y double, r double, dz double, falloff string"


class Plans:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _heads(self, plan_id: str) -> list[int]:
        fs, p = self._fs(f"{self.path}/heads/{plan_id}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def head(self, plan_id: str) -> str | None:
        n = self._heads(plan_id)
        if not n:
            return None
        return self.spark.read.text(f"{self.path}/heads/{plan_id}/{n[-1]}").first()[0]

    def commit(self, plan_id: str, expected: str | None, edits: list[dict], base_id: str = "base") -> str:
        """Write a revision on top of ``expected``; a plan whose head has moved meanwhile is a conflict."""
        if self.head(plan_id) != expected:
            raise QueryError("the plan has moved", head=self.head(plan_id), expected=expected)
        done = E.normalise(edits)
        revision = f"rev_{uuid.uuid4().hex}"
        rows = [(revision, plan_id, expected, E.content_hash(base_id, done), e["edit_id"], e["ordinal"], e["kind"], e["x"], e["y"], e["r"], e["dz"], e["falloff"]) for e in done]
        self.spark.createDataFrame(rows or [(revision, plan_id, expected, E.content_hash(base_id, []), *[None] * 8)], EDIT).write.mode("append").parquet(f"{self.path}/revisions")
        fs, p = self._fs(f"{self.path}/heads/{plan_id}/{len(self._heads(plan_id))}")
        try:
            out = fs.create(p, False)
        except Exception as e:  # the marker exists: another commit was first
            raise QueryError("the plan has moved", expected=expected) from e
        out.write(bytearray(revision.encode()))
        out.close()
        return revision

    def branch(self, plan_id: str, new_id: str) -> str:
        """A new plan whose head is the same revision."""
        head = self.head(plan_id)
        if head is None or self.head(new_id):
            raise QueryError("nothing to branch, or the name is taken", plan=plan_id, branch=new_id)
        fs, p = self._fs(f"{self.path}/heads/{new_id}/0")
        out = fs.create(p, False)
        out.write(bytearray(head.encode()))
        out.close()
        return head

    def revisions(self) -> DataFrame:
        return self.spark.read.schema(EDIT).parquet(f"{self.path}/revisions")

    def edits(self, revision_id: str) -> DataFrame:
        return self.revisions().where("edit_id is not null").where(f"revision_id = '{revision_id}'")

    def nodes(self) -> DataFrame:
        """``id, parent`` of all revisions, for ``operators.store.ancestry``."""
        return self.revisions().selectExpr("revision_id as id", "parent").distinct()


def describe(edits: list[dict]) -> str:
    """A one-line summary of proposed edits."""
    kinds: dict[str, int] = {}
    for e in edits:
        kinds[e["kind"]] = kinds.get(e["kind"], 0) + 1
    return json.dumps(kinds, sort_keys=True)
