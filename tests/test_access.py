"""Access as table functions, and files that get their name once."""

from quire.operators import access, listings
from quire.operators.tagging import TagModel
from quire.session import give_name, keep_once


def test_table_functions_follow_the_permission_classes(spark):
    departments = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    people = [(1, "x", 1, False), (2, "y", None, False), (3, "z", 2, True), (4, "w", None, True), (5, "v", 2, None)]
    users = spark.createDataFrame(people, "id long, username string, department_id long, is_staff boolean")
    manuals = spark.createDataFrame([(10, "m", 1), (11, "n", 2), (12, "o", 2)], "id long, title string, department_id long")
    sections = spark.createDataFrame([(k, 10 + k % 3) for k in range(6)], "id long, manual_id long")
    access.install(spark, departments, users, manuals, sections)
    of = {10: 1, 11: 2, 12: 2}
    for reader, _, own, staff in [*people, (None, None, None, None), (99, None, None, None)]:
        seen = {}
        for r in access.visible(spark, reader).collect():
            seen.setdefault(r["what"], set()).add(r["id"])
        may = {m for m, d in of.items() if staff or d == own}
        assert seen.get("departments") == {1, 2}
        assert seen.get("manuals", set()) == may == {r["id"] for r in listings.readable(manuals, own, bool(staff)).collect()}
        assert seen.get("sections", set()) == {k for k in range(6) if 10 + k % 3 in may}
        assert seen.get("uploads", set()) == {m for m, d in of.items() if d == own}
        assert seen.get("users", set()) == ({1, 2, 3, 4, 5} if staff else set())
    assert spark.sql("SELECT title FROM manuals_for(1)").collect()[0]["title"] == "m"


def test_a_name_is_given_once(spark, tmp_path):
    path = (tmp_path / "x" / "model.json").as_uri()
    assert give_name(spark, path, "first\nline") and not give_name(spark, path, "second")
    assert keep_once(spark, path, lambda: 1 / 0) == "first\nline"
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["model.json"]


def test_two_sessions_that_train_together_take_one_model(spark, tmp_path, monkeypatch):
    from quire.operators import tagging

    path, inner, made = (tmp_path / "model.json").as_uri(), tagging.train, []

    def slow():
        if not made:  # while this session trains, another one finishes
            made.append(1)
            other = TagModel.load_or_train(path, spark.newSession())
            made.append(other)
        return inner()

    monkeypatch.setattr(tagging, "train", slow)
    mine = TagModel.load_or_train(path, spark)
    assert mine.__dict__ == made[1].__dict__ and TagModel.load_or_train(path, spark).weights == mine.weights
