"""Versioned model documents: a folder of commits that readers see whole or not at all.

Spark writes a commit's documents as Parquet into a folder of its own; the
commit exists once the next number in ``log/`` names that folder. A number is
taken by an atomic create-if-absent, so of two writers one takes it and the
other looks at what was committed before it tries the next. Nothing that a
reader may hold is changed; deleting is a commit too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model_files import slug

SCHEMA = "model string, kind string, text string, deleted boolean"
KEY = ["model", "kind"]


class Refused(Exception):
    """A commit that would break a rule; nothing was written."""


class Store:
    """Documents by (model, kind), kind being ``model`` or ``baseline``, in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("log").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("log"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _entries(self) -> list[int]:
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(self._path("log")) if s.getPath().getName().endswith(".json"))

    def _entry(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"log/{number:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def head(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max(self._entries(), default=0)

    def _take(self, number: int, entry: dict) -> bool:
        """Does the entry become that number; atomic, and readers see it only with its text."""
        draft = self._path(f"log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        target = self._path(f"log/{number:020d}.json")
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would replace a local file
                local = lambda p: self._jvm.java.nio.file.Path.of(p.toUri())
                self._jvm.java.nio.file.Files.createLink(local(self._fs.makeQualified(target)), local(self._fs.makeQualified(draft)))
                return True
            return bool(self._fs.rename(draft, target))
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    def changes(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """(number, model, kind, text, deleted): the rows of commits by number; a compaction stands for all before it."""
        numbers = [n for n in self._entries() if after < n and (upto is None or n <= upto)]
        entries = [(n, self._entry(n)) for n in numbers]
        base = max((i for i, (_, e) in enumerate(entries) if e["whole"]), default=0) if after == 0 else 0
        out = self.spark.createDataFrame([], f"number long, {SCHEMA}")
        for n, e in entries[base:]:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/data/{e['data']}")
            out = out.unionByName(rows.select(F.lit(n).cast("long").alias("number"), "*"))
        return out

    def documents(self, at: int | None = None) -> DataFrame:
        """(model, kind, text) as of a commit (default: the last)."""
        last = self.changes(upto=self.head() if at is None else at).groupBy(*KEY).agg(F.max_by(F.struct("text", "deleted"), "number").alias("d"))
        return last.where("NOT d.deleted").select(*KEY, "d.text")

    def _commit(self, rows: Callable[[int], DataFrame], absent: DataFrame | None = None, present: DataFrame | None = None, whole: bool = False) -> int:
        """Commit the rows made from the last commit; keys in ``absent`` must not be there by then, those in ``present`` must.

        Where another writer takes the number first, everything is looked at anew.
        """
        while True:
            seen, data = self.head(), uuid.uuid4().hex
            now = self.documents(seen).select(*KEY)
            for keys, wrong, says in ((absent, "left_semi", "already exists"), (present, "left_anti", "not found")):
                if bad := keys.join(now, KEY, wrong).orderBy(*KEY).head(5) if keys is not None else []:
                    raise Refused(f"{', '.join(r.model for r in bad)}: {says}")
            made = rows(seen).select("model", "kind", F.col("text").cast("string").alias("text"), F.col("deleted").cast("boolean").alias("deleted"))
            made.write.parquet(f"{self.folder}/data/{data}")
            if self._take(seen + 1, {"data": data, "whole": whole}):
                return seen + 1
            self._fs.delete(self._path(f"data/{data}"), True)

    def write(self, docs: DataFrame) -> int:
        """Put (model, kind, text) in place of what is there; the last writer wins."""
        return self._commit(lambda seen: docs.withColumn("deleted", F.lit(False)))

    def create(self, docs: DataFrame) -> int:
        """Put new documents; refused if one of them is there, also if another writer put it there meanwhile."""
        return self._commit(lambda seen: docs.withColumn("deleted", F.lit(False)), absent=docs.select(*KEY))

    def delete(self, model: DataFrame) -> int:
        """Delete all kinds of the named models; names that are not there do no harm."""
        asked = model.select("model").distinct()
        return self._commit(lambda seen: _gone(self.documents(seen).join(asked, "model", "left_semi")))

    def rename(self, names: DataFrame) -> int:
        """Rename models (old, new) with their baselines in one commit; new names become slugs.

        Refused if a new name is empty, is there already or is asked for twice,
        or an old one is not there.
        """
        asked = names.select("old", slug(F.col("new")).alias("new"))
        if not asked.where("new = ''").isEmpty():
            raise Refused("Name cannot be empty")
        if twice := asked.groupBy("new").count().where("count > 1").head(5):
            raise Refused(f"{', '.join(r.new for r in twice)}: already exists")

        def moved(seen: int) -> DataFrame:
            known = self.documents(seen).join(asked.withColumnRenamed("old", "model"), "model")
            return known.select(F.col("new").alias("model"), "kind", "text", F.lit(False).alias("deleted")).unionByName(_gone(known))

        key = lambda c: asked.select(F.col(c).alias("model"), F.lit("model").alias("kind"))
        return self._commit(moved, absent=key("new"), present=key("old"))

    def compact(self) -> int:
        """One commit that holds all documents, so that readers need not look before it."""
        return self._commit(lambda seen: self.documents(seen).withColumn("deleted", F.lit(False)), whole=True)


def _gone(docs: DataFrame) -> DataFrame:
    return docs.select(*KEY, F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))


def named(docs: DataFrame, kind: str = "model", model: Column | str = "model") -> DataFrame:
    """(model, kind, text) of documents of one kind."""
    return docs.select((F.col(model) if isinstance(model, str) else model).alias("model"), F.lit(kind).alias("kind"), "text")
