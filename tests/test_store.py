"""Commits of model documents: readers, refusals, races."""

import threading

import pytest

from tessella.sources import model_files
from tessella.sources.store import Refused, Store, named

DOCS = "model string, kind string, text string"


def docs(spark, *rows):
    return spark.createDataFrame([(m, k, t) for m, k, t in rows], DOCS)


def now(store, at=None):
    return {(r.model, r.kind): r.text for r in store.documents(at).collect()}


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"))
    out.create(docs(spark, ("a", "model", "A1"), ("a", "baseline", "A0"), ("b", "model", "B1")))
    return out


def test_every_commit_stays_readable(spark, store):
    assert store.write(docs(spark, ("a", "model", "A2"), ("c", "model", "C1"))) == 2
    assert store.delete(spark.createDataFrame([("a",), ("nobody",)], "model string")) == 3
    assert now(store, 1) == {("a", "model"): "A1", ("a", "baseline"): "A0", ("b", "model"): "B1"}
    assert now(store, 2)["a", "model"] == "A2"
    assert now(store) == {("b", "model"): "B1", ("c", "model"): "C1"}
    store.create(docs(spark, ("a", "model", "A9")))  # a deleted name is free
    before = now(store)
    store.compact()
    assert now(store) == before and store.changes().count() == len(before)
    assert now(store, 2)["a", "model"] == "A2"


def test_collisions_are_refused_and_leave_nothing(spark, store, tmp_path):
    with pytest.raises(Refused, match="a: already exists"):
        store.create(docs(spark, ("z", "model", "Z"), ("a", "model", "other")))
    rename = lambda *names: store.rename(spark.createDataFrame(list(names), "old string, new string"))
    for names, says in (([("a", "  ")], "empty"), ([("a", "B")], "b: already exists"), ([("gone", "n")], "gone: not found"), ([("a", "x!"), ("b", "x?")], "x-: already exists")):
        with pytest.raises(Refused, match=says):
            rename(*names)
    assert store.head() == 1 and len(list((tmp_path / "store" / "data").iterdir())) == 1
    rename(("a", " New Name! "))
    assert now(store) == {("new-name-", "model"): "A1", ("new-name-", "baseline"): "A0", ("b", "model"): "B1"}


def test_of_two_creators_of_a_name_one_is_refused(spark, store):
    gate, said = threading.Barrier(2), []
    take = Store._take

    class Racing(Store):
        waited = False

        def _take(self, number, entry):  # both have looked before either commits
            if not self.waited:
                self.waited = True
                gate.wait(60)
            return take(self, number, entry)

    def create(text):
        try:
            said.append((Racing(spark, store.folder).create(docs(spark, ("n", "model", text))), text))
        except Refused as refused:
            said.append((None, str(refused)))

    threads = [threading.Thread(target=create, args=(t,)) for t in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    (won,) = [text for number, text in said if number == 2]
    assert (None, "n: already exists") in said and len(said) == 2
    assert now(store)["n", "model"] == won and store.head() == 2


def test_a_race_of_other_names_keeps_both(spark, store):
    numbers = []
    threads = [threading.Thread(target=lambda k=k: numbers.append(Store(spark, store.folder).create(docs(spark, (f"n{k}", "model", str(k)))))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(numbers) == [2, 3, 4, 5] and {f"n{k}" for k in range(4)} <= {m for m, _ in now(store)}


def test_a_reader_during_a_write_sees_the_old_documents(spark, store):
    seen = []

    class Watched(Store):
        def _take(self, number, entry):  # all is written, nothing is committed
            seen.append(now(Store(spark, self.folder))["a", "model"])
            return super()._take(number, entry)

    reader = store.documents()
    Watched(spark, store.folder).write(docs(spark, ("a", "model", "A2")))
    assert seen == ["A1"] and now(store)["a", "model"] == "A2"
    assert {(r.model, r.text) for r in reader.collect()} >= {("a", "A1")}  # what was opened before stays as it was


def test_documents_of_a_folder_of_files(spark, store, tmp_path):
    folder = str(tmp_path / "files")
    assert model_files.write_documents(spark.createDataFrame([("a", '{"nodes": []}'), ("ü b", "{}")], "model string, text string"), folder) == 2
    read = model_files.read_documents(spark, folder)
    assert sorted(r.model for r in read.select("model").collect()) == ["a", "ü b"]
    assert named(spark.createDataFrame([("a", "x")], "model string, text string"), "baseline").first() == ("a", "baseline", "x")
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["a.scry", "ü b.scry"]


def test_project_folders(spark, tmp_path):
    folder = tmp_path / "project"
    one = spark.createDataFrame([("model", "{}")], "model string, text string")
    model_files.write_documents(one, str(folder), project=True)
    assert (folder / ".gitignore").read_text() == model_files.PROJECT_IGNORE
    (folder / ".gitignore").write_text("mine\n")
    model_files.write_documents(one, str(folder), project=True)
    assert (folder / ".gitignore").read_text() == "mine\n"
    for name in ("model.baseline.scry", ".implementing", ".sync", "other.scry"):
        (folder / name).write_text("{}")
    gone = spark.createDataFrame([("model",), ("nobody",)], "model string")
    model_files.delete_documents(gone, str(folder), project=True)
    assert sorted(p.name for p in folder.iterdir()) == [".gitignore", "other.scry"]


def test_slug(spark):
    from pyspark.sql import functions as F

    from tessella.sources.model_files import slug

    rows = spark.createDataFrame([("  My Model_2-x ",), ("Ünï",), ("",), (None,)], "n string")
    assert [r[0] for r in rows.select(slug(F.col("n"))).collect()] == ["my-model_2-x", "-n-", "", None]
