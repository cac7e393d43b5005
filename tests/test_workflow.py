"""Edits, reviews, deletions, listings and files against hand-made tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import listings, workflow
from quire.operators.entities import SCHEMAS, upgrade
from quire.sources import files, tables
from quire.streaming import ingest


def frame(spark, entity, *rows):
    names = [f.name for f in SCHEMAS[entity].fields]
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, SCHEMAS[entity])


@pytest.fixture(scope="module")
def world(spark):
    return {
        "department": frame(spark, "department", {"id": 1, "name": "Quality"}, {"id": 2, "name": "Safety"}),
        "user": frame(spark, "user", {"id": 1, "username": "ann", "role": "staff", "is_approved": True, "is_staff": False, "department_id": 1}, {"id": 2, "username": "bob", "role": "admin", "is_approved": True, "is_staff": True}, {"id": 3, "username": "cy", "role": "staff", "is_approved": False, "is_staff": False, "department_id": 2}),
        "manual": frame(spark, "manual", {"id": 1, "title": "M1", "department_id": 1, "uploaded_by_id": 1, "version": 1}, {"id": 2, "title": "M2", "department_id": 2, "version": 1}),
        "section": frame(spark, "section", {"id": 1, "manual_id": 1, "subtitle": "S", "content": "c0", "tag": "POLICY", "page_number": 5, "order": 0, "version": 1}, {"id": 2, "manual_id": 1, "subtitle": "T", "content": "x" * 300, "tag": "UNTAGGED", "order": 0, "version": 1}),
        "section_history": frame(spark, "section_history", {"id": 1, "section_id": 2, "version": 0, "subtitle": "old", "content": "o"}),
        "revision": frame(spark, "revision", {"id": 1, "section_id": 1, "submitted_by_id": 1, "uploaded_file": "f.txt", "diff_text": "d" * 400, "status": "pending", "reviewer_notes": ""}, {"id": 2, "section_id": 2, "status": "rejected", "diff_text": "", "reviewer_notes": ""}),
    }


def events(spark, *rows):
    return frame(spark, "edit_event", *rows)


def test_version_fold(spark, world):
    log = events(
        spark,
        {"section_id": 1, "seq": 1, "has_content": True, "content": "c1", "has_page": True, "page_number": None, "actor": 1},
        {"section_id": 1, "seq": 2, "has_subtitle": True, "subtitle": "T", "actor": 2},
        {"section_id": 1, "seq": 3, "has_content": True, "content": "", "has_page": True, "page_number": 9},
        {"section_id": 99, "seq": 1, "has_content": True, "content": "lost"},
        {"section_id": 1, "seq": 4, "has_content": True, "content": None},
    )
    now, past = workflow.fold_edits(world["section"], log)
    row = now.filter("id = 1").first()
    assert (row["subtitle"], row["content"], row["page_number"], row["version"], row["tag"]) == ("T", "", 9, 4, "PROCEDURE")
    assert now.filter("id = 2").first() == world["section"].filter("id = 2").first()
    assert [(r["version"], r["subtitle"], r["content"], r["edited_by_id"]) for r in past.orderBy("version").collect()] == [(1, "S", "c0", 1), (2, "S", "c1", 2), (3, "T", "c1", None)]
    manuals = workflow.bump_manuals(world["manual"], world["section"], workflow.valid_edits(log)[0])
    assert {r["id"]: r["version"] for r in manuals.collect()} == {1: 4, 2: 1}
    seen = listings.history(past, now, world["user"], 1).collect()
    assert [(r["version"], r["edited_by"]) for r in seen] == [(1, "ann"), (2, "bob"), (3, "N/A"), (4, "Current")]
    assert [r["previous_content"] for r in listings.previous(listings.history(past, now, world["user"], 1)).orderBy("version").collect()] == [None, "c0", "c1", "c1"]


def test_review_and_approval(spark, world):
    reviews = spark.createDataFrame([(1, 1, "rejected", "no", None), (1, 2, "approved", None, None), (2, 3, "pending", "bad", None)], "id long, seq int, status string, notes string, ts timestamp")
    after, refused = workflow.review(world["revision"], reviews)
    assert {r["id"]: (r["status"], r["reviewer_notes"]) for r in after.collect()} == {1: ("approved", ""), 2: ("rejected", "")}
    assert [r["seq"] for r in refused.collect()] == [3]
    texts = spark.createDataFrame([("f.txt", "new text", None)], "uploaded_file string, text string, error string")
    made = workflow.approval_events(reviews, world["revision"], texts)
    now, past = workflow.fold_edits(world["section"], made)
    assert now.filter("id = 1").first()["content"] == "new text" and past.first()["edited_by_id"] == 1
    broken = spark.createDataFrame([("f.txt", None, "unreadable")], "uploaded_file string, text string, error string")
    assert workflow.approval_events(reviews, world["revision"], broken).isEmpty()
    assert [r["error"] for r in workflow.failed_approvals(reviews, world["revision"], broken).collect()] == ["unreadable"]
    assert [r["error"] for r in workflow.failed_approvals(reviews, world["revision"], broken.limit(0)).collect()] == ["file not found"]
    assert workflow.failed_approvals(reviews, world["revision"], texts).isEmpty()
    with pytest.raises(workflow.Rejected):
        workflow.check_status("pending")


def test_submit(spark, world):
    up = spark.createDataFrame([(9, 1, 1, "g.txt", "c9", None)], "id long, section_id long, submitted_by_id long, uploaded_file string, text string, submitted_at timestamp")
    row = workflow.submit_revisions(world["revision"], world["section"], up).filter("id = 9").first()
    assert row["status"] == "pending" and row["diff_text"] == "--- \n+++ \n@@ -1 +1 @@\n-c0\n+c9"


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_deletes(spark, world):
    gone = workflow.delete(world, "department", spark.createDataFrame([(1,)], "id long"))
    assert {k: ids(v) for k, v in gone.items()} == {"department": [2], "user": [1, 2, 3], "manual": [2], "section": [], "section_history": [], "revision": []}
    assert gone["user"].filter("id = 1").first()["department_id"] is None
    gone = workflow.delete(world, "user", spark.createDataFrame([(1,)], "id long"))
    assert gone["manual"].filter("id = 1").first()["uploaded_by_id"] is None and gone["revision"].filter("id = 1").first()["submitted_by_id"] is None
    gone = workflow.delete(world, "section", spark.createDataFrame([(2,)], "id long"))
    assert ids(gone["section"]) == [1] and ids(gone["section_history"]) == [] and ids(gone["revision"]) == [1]


def test_inserts(spark, world):
    new = spark.createDataFrame([(5, "ann", 1), (6, "dee", 77), (7, "dee", 2), (8, "", 1)], "id long, username string, department_id long")
    users, refused = workflow.register_users(world["user"], world["department"], new)
    assert ids(refused) == [5, 7, 8]
    row = users.filter("id = 6").first()
    assert (row["is_approved"], row["role"], row["department_id"]) == (False, "staff", None)
    assert workflow.approve_user(users, 6).filter("id = 6").first()["is_approved"]
    rows = spark.createDataFrame([(7, 1, "A", "", "x", "3"), (8, 1, "", "c", "1", "1"), (9, 1, "B", "step", "4", None)], "id long, manual_id long, subtitle string, content string, page_number string, order string")
    made, bad = workflow.create_sections(world["section"], rows)
    assert ids(bad) == [8]
    assert [(r["tag"], r["page_number"], r["order"], r["version"]) for r in made.filter("id > 6").orderBy("id").collect()] == [("UNTAGGED", None, 3, 1), ("PROCEDURE", 4, 0, 1)]


def test_listings(spark, world):
    w = world
    assert [tuple(r) for r in listings.users(w["user"], w["department"], False).collect()] == [(3, "cy", None, "Safety")]
    assert {r["username"]: r["department"] for r in listings.users(w["user"], w["department"], True).collect()} == {"ann": "Quality", "bob": "N/A"}
    assert {r["id"]: (r["uploaded_by"], r["sections"]) for r in listings.manuals(w["manual"], w["department"], w["user"], w["section"]).collect()} == {1: ("ann", 2), 2: ("N/A", 0)}
    rows = listings.sections(w["section"], w["manual"], w["department"], 1).collect()
    assert [r["id"] for r in rows] == [1, 2] and len(rows[1]["preview"]) == 200
    assert listings.sections(w["section"], w["manual"], w["department"], 1, 2, False).isEmpty()
    with pytest.raises(listings.NotFound):
        listings.sections(w["section"], w["manual"], w["department"], 5)
    every = listings.revisions(w["revision"], w["section"], w["manual"], w["department"], w["user"], "")
    assert {r["id"]: (r["manual"], r["submitted_by"], len(r["diff_preview"])) for r in every.collect()} == {1: ("M1", "ann", 300), 2: ("M1", "N/A", 0)}
    assert listings.revisions(w["revision"], w["section"], w["manual"], w["department"], w["user"], "zzz").isEmpty()
    assert {r["id"]: (r["may_list"], r["may_upload"]) for r in listings.access_counts(w["user"], w["manual"]).collect()} == {1: (1, 1), 2: (2, 0), 3: (1, 1)}
    assert ids(listings.readable(w["manual"], None, False)) == [] and ids(listings.readable(w["manual"], None, True)) == [1, 2]
    assert {r["username"]: r["department"] for r in listings.login(w["user"], w["department"]).collect()}["bob"] is None
    assert ids(listings.admin_list(w["user"], ["id"], department_id=None)) == [2]
    assert listings.exists(w["user"], "username", "ann") and not listings.exists(w["user"], "username", "Ann")


def test_files_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_bytes(b"SCOPE\nab\xff\xc3\xa9 is a long line of text.")
    (source / "b.doc").write_bytes(b"zz")
    read = files.extract(files.read_files(spark, str(source))).select(F.element_at(F.split("path", "/"), -1).alias("n"), "raw_text", "error").orderBy("n").collect()
    assert read[0]["raw_text"] == "SCOPE\nabé is a long line of text." and "Unsupported" in read[1]["error"]
    got = files.ingest(files.read_files(spark, str(source))).collect()
    assert [(r["subtitle"], r["content"]) for r in got] == [("SCOPE", "abé is a long line of text.")]
    query = ingest.start(ingest.watch(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_old_tables(spark, tmp_path):
    spark.createDataFrame([(1, "M")], "id long, title string").write.parquet(str(tmp_path / "manual"))
    row = tables.read_entity(spark, str(tmp_path), "manual").first()
    assert row["version"] == 1 and row["title"] == "M" and row["file"] is None
    tables.write_entity(upgrade(spark.createDataFrame([(2, "N")], "id long, title string"), "manual"), str(tmp_path), "manual")
    assert tables.read_entity(spark, str(tmp_path), "manual").count() == 2
    assert tables.as_json(spark.createDataFrame([(None,)], "a string")).first()[0] == '{"a":null}'


def test_uploads(spark, world, tmp_path):
    rows = spark.createDataFrame([(5, "New", 1, "a.txt"), (6, "Broken", 1, "b.txt"), (7, "", 1, "c.txt"), (8, "Headings", 2, "d.txt")], "id long, title string, department_id long, file string")
    texts = spark.createDataFrame([("a.txt", "Intro line here.\n1. Steps\nFollow these steps", None), ("b.txt", None, "unreadable"), ("d.txt", "SCOPE", None)], "file string, text string, error string")
    manuals, sections, refused = workflow.upload_manuals(world["manual"], world["section"], rows, texts)
    assert ids(refused) == [7] and ids(manuals) == [1, 2, 5, 6, 8]
    made = [(r["manual_id"], r["order"], r["subtitle"], r["tag"], r["version"]) for r in sections.filter("manual_id > 2").orderBy("manual_id", "order").collect()]
    assert made == [(5, 0, "Introduction", "PROCEDURE", 1), (5, 1, "1. Steps", "PROCEDURE", 1), (8, 0, "Headings", "PROCEDURE", 1)]
    (tmp_path / "a.txt").write_text("SCOPE\nAll of the staff are covered.")
    path = f"file:{tmp_path}/a.txt"
    stored = spark.createDataFrame([(1, path), (2, ""), (3, "file:/gone.txt")], "id long, file string")
    got = {r["id"]: (r["text"], r["error"]) for r in files.read_back(stored, files.read_files(spark, str(tmp_path))).collect()}
    assert got == {1: ("SCOPE\nAll of the staff are covered.", None), 2: (None, "no file"), 3: (None, "file not found")}


def test_refusals(spark, world):
    up = spark.createDataFrame([(1, 1, 1, "f"), (2, 1, 2, "f"), (3, 1, 3, "f"), (4, 1, 1, "")], "id long, section_id long, submitted_by_id long, uploaded_file string")
    good, bad = workflow.allowed_uploads(up, world["user"], world["section"], world["manual"])
    assert ids(good) == [1] and ids(bad) == [2, 3, 4]
    log = events(spark, {"section_id": 1, "seq": 1, "has_content": True}, {"section_id": 1, "seq": 2, "has_page": True}, {"section_id": 1, "seq": 3, "has_subtitle": False})
    good, bad = workflow.valid_edits(log)
    assert [r["seq"] for r in bad.collect()] == [1] and good.count() == 2
    df = spark.createDataFrame([("abcdefgh", "abcdefgh"), ("abc", "abc"), ("abcdefgh", "x")], "a string, b string")
    assert [bool(r[0]) for r in df.select(workflow.password_problem(F.col("a"), F.col("b"))).collect()] == [False, True, True]
