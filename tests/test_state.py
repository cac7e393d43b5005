"""The section store (batches, repeats, crashes, two writers, streams), stored files and deletions."""

import random
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import workflow
from quire.operators.entities import FOREIGN_KEYS, SCHEMAS
from quire.operators.state import Conflict, SectionStore, UniqueTable
from quire.plans.registry import REGISTRY
from quire.session import shared_dir
from quire.sources import files


def sections_of(spark, n=60):
    return spark.createDataFrame([(k, k % 5, f"s{k}", f"text {k}", "UNTAGGED", None, k, 1) for k in range(n)], SCHEMAS["section"])


def events_of(spark, batches=4, n=60, seed=3):
    rng = random.Random(seed)
    rows = [[(rng.randrange(n), 100 * b + k, rng.random() < 0.5, f"t{b}-{k}", rng.random() < 0.5, f"policy text {b} {k}", rng.random() < 0.3, rng.choice([None, k]), False, None, k, None) for k in range(rng.randint(1, 25))] for b in range(batches)]
    return [spark.createDataFrame(x, SCHEMAS["edit_event"]) for x in rows]


def state(df):
    return sorted(map(tuple, df.select("id", "subtitle", "content", "tag", "page_number", "order", "version").collect()))


def old(df):
    return sorted(map(tuple, df.select("section_id", "version", "subtitle", "content", "tag").collect()))


def whole(spark, batches):
    now, past = workflow.fold_edits(sections_of(spark), __import__("functools").reduce(lambda a, b: a.unionByName(b), batches))
    return state(now), old(past)


def test_batches_fold_like_the_whole_log(spark, tmp_path):
    batches = events_of(spark)
    store = SectionStore.create(spark, str(tmp_path / "s"), sections_of(spark), buckets=7)
    assert state(store.sections()) == state(sections_of(spark)) and store.history().count() == 0
    for k, batch in enumerate(batches):
        assert store.apply(batch, k) and not store.apply(batch, k)
        assert not SectionStore(spark, str(tmp_path / "s")).apply(batch, 0)
    assert (state(store.sections()), old(store.history())) == whole(spark, batches)


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    store = SectionStore.create(spark, str(tmp_path / "s"), sections_of(spark), buckets=16)
    read, inner = [], store._read
    monkeypatch.setattr(store, "_read", lambda manifest, buckets=None: read.append(buckets) or inner(manifest, buckets))
    one = events_of(spark, 1)[0].limit(1)
    before = store._manifest()["data"]
    store.apply(one, 0)
    after = store._manifest()["data"]
    assert len(read[0]) == 1 and sum(before[b] != after[b] for b in before) == 1


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    batches = events_of(spark, 2)
    store = SectionStore.create(spark, str(tmp_path / "s"), sections_of(spark), buckets=4)
    store.apply(batches[0], 0)
    kept = state(store.sections())
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.apply(batches[1], 1)
    again = SectionStore(spark, str(tmp_path / "s"))
    assert state(again.sections()) == kept
    assert again.apply(batches[1], 1)
    assert (state(again.sections()), old(again.history())) == whole(spark, batches)


def test_of_two_writers_one_fails(spark, tmp_path):
    batches = events_of(spark, 2)
    store = SectionStore.create(spark, str(tmp_path / "s"), sections_of(spark), buckets=4)
    manifest = store._manifest()
    store.apply(batches[0], 0)
    with pytest.raises(Conflict):
        store._commit(manifest | {"version": 1, "batch": 9})
    assert store._manifest()["batch"] == 0


def test_a_stream_delivers_a_batch_again(spark, tmp_path):
    batches = events_of(spark, 3)
    store = SectionStore.create(spark, str(tmp_path / "s"), sections_of(spark), buckets=4)
    log = str(tmp_path / "log")
    stream = lambda: spark.readStream.schema(SCHEMAS["edit_event"]).parquet(log)
    batches[0].coalesce(1).write.parquet(log)
    store.follow(stream(), str(tmp_path / "c")).awaitTermination()
    # The stream stopped before it could note that its first batch was done.
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    store.follow(stream(), str(tmp_path / "c")).awaitTermination()
    assert store._manifest()["version"] == 1
    batches[1].coalesce(1).write.mode("append").parquet(log)
    store.follow(stream(), str(tmp_path / "c")).awaitTermination()
    assert (state(store.sections()), old(store.history())) == whole(spark, batches[:2])


def test_of_two_batches_with_one_name_one_row_is_kept(spark, tmp_path):
    schema = "id long, name string"
    for order in (0, 1):
        store = UniqueTable.create(spark, str(tmp_path / f"u{order}"), spark.createDataFrame([(1, "a"), (2, "a"), (3, "")], schema), "name")
        other = UniqueTable(spark, str(tmp_path / f"u{order}"))
        batches = [spark.createDataFrame([(10, "b"), (11, "c"), (12, "a")], schema), spark.createDataFrame([(20, "b"), (21, "d"), (22, None)], schema)]
        commit, late = store._commit, []

        def overtaken(manifest):
            if not late:  # between this writer's reading and its commit the other one finishes
                late.append(other.insert(batches[1 - order]))
            commit(manifest)

        store._commit = overtaken
        refused = store.insert(batches[order])
        first, second = {r["id"] for r in late[0].collect()}, {r["id"] for r in refused.collect()}
        assert (first, second) == (({22}, {10, 12}) if order == 0 else ({12}, {20, 22}))
        kept = {r["id"] for r in store.rows().collect()}
        assert kept == ({1, 20, 21, 11} if order == 0 else {1, 10, 11, 21})
        assert store.rows().count() == 4


def test_only_named_files_are_opened(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f {k}.txt").write_bytes(b"line %d\xff" % k)
    every = {r[0].rsplit("%20", 1)[1]: r[0] for r in spark.read.format("binaryFile").load(str(tmp_path)).select("_metadata.file_path").collect()}
    rows = spark.createDataFrame([(1, every["3.txt"]), (2, every["4.txt"]), (3, every["4.txt"] + "x"), (4, None), (5, "")], "id long, file string")
    got = files.read_named(spark, str(tmp_path), rows)
    assert sorted(bytes(r["content"]) for r in got.collect()) == [b"line 3\xff", b"line 4\xff"]
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == 2
    back = {r["id"]: (r["text"], r["error"]) for r in files.read_back(rows, got).collect()}
    assert back == {1: ("line 3", None), 2: ("line 4", None), 3: (None, "file not found"), 4: (None, "no file"), 5: (None, "no file")}
    assert files.read_named(spark, str(tmp_path), rows, most=1).count() == 30


def test_files_are_written_without_a_folder_or_checksum_each(spark, tmp_path):
    turns = [(k, t, f"said {k} {t}") for k in (-7, 0, 1, 2, 3, 4, 5, 8, 10, 17, 18) for t in (1, 0)] + [(None, 2, "b"), (None, 1, "a"), (9, 0, None), (9, 1, "z"), (14, 0, None), (15, 0, "\u00e9\n")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    shared = Path(urlparse(shared_dir(spark)).path)
    before = set(shared.glob("quire-files-*"))
    got = REGISTRY["stored_files"][0](spark, str(tmp_path)).collect()
    (folder,) = set(shared.glob("quire-files-*")) - before
    made = [x for x in folder.rglob("*") if x.is_file()]
    assert len(made) == 14 and {x.suffix for x in made} == {".txt", ".csv"}
    assert sum(x.is_dir() for x in folder.rglob("*")) <= 8  # one a task at most
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.execute(REGISTRY["stored_files"][1]).fetchall()))


def test_files_are_the_same_whoever_writes_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", "txt"), (-2, "", "txt"), (None, None, "txt"), (3, "\u00e9", "txt"), (4, "x", "csv")], "key long, text string, ending string").repartition(3)
    for own in (tmp_path / "a b%20", tmp_path / "c"):
        there = files.write_each(rows, f"file://{own}", by_spark=own.name == "c")
        found = there.join(files.read_named(spark, f"file://{own}", there, "path"), "path")
        assert {r["key"]: bytes(r["content"]) for r in found.collect()} == {1: b"a\nb\n", -2: b"\n", None: b"\n", 3: b"\xc3\xa9\n", 4: b"x\n"}
        assert {r["key"]: r["path"][-4:] for r in there.collect()}[4] == ".csv"
    assert files.write_each(rows.limit(0), f"file://{tmp_path}/none").count() == 0


def test_a_deletion_scans_each_table_once(spark, tmp_path):
    tables = {
        "department": spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"),
        "manual": spark.createDataFrame([(k, k % 2 + 1, k) for k in range(6)], "id long, department_id long, uploaded_by_id long"),
        "section": spark.createDataFrame([(k, k % 6) for k in range(30)], "id long, manual_id long"),
        "section_history": spark.createDataFrame([(k, k % 30, 1) for k in range(60)], "id long, section_id long, edited_by_id long"),
        "revision": spark.createDataFrame([(k, k % 30, 2) for k in range(60)], "id long, section_id long, submitted_by_id long"),
        "user": spark.createDataFrame([(k, k % 3) for k in range(9)], "id long, department_id long"),
    }
    for name, df in tables.items():
        df.withColumn("gone", F.lit(name)).write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in tables}
    out = workflow.delete(tables, "department", spark.createDataFrame([(1,), (1,), (7,)], "id long"))
    assert {n: out[n].count() for n in out} == {"department": 1, "manual": 3, "section": 15, "section_history": 30, "revision": 30, "user": 9}
    assert {r["department_id"] for r in out["user"].collect()} == {0, 2, None}
    for name, df in out.items():
        read = {f.split("/")[-2] for f in df.inputFiles()}
        references = sum(child == name for child, *_ in FOREIGN_KEYS)
        assert read & set(tables) == {name} and df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 1 + max(references, 1)
