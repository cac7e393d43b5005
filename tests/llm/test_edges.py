"""Every operator and the pipeline on columns whose names clash with inner ones, on empty tables and on tables of nulls."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe_reuse, collision, dac_file, language_id, licenses, mixing, quality_rules, rule_ensemble, simhash, toxicity

#: Names that operators use inside, have used, or that are awkward in themselves.
AWKWARD = ["text_", "TEXT__", "bucket", "before", "place", "source_key", "rank_in", "class", "turn", "held", "stage_", "stage_score", "found", "n", "n_", "fp_", "low", "root", "size", "kept_key", "row_key", "first_row", "h", "id", "y", "w", "words", "chunks", "n_bytes", "text_hash", "measured_ratio", "stat_n_chars", "place_", "at", "k2", "__s", "__quire_text", "__fp", "a.b", "a`b", "ahead", "blocks"]
RESULTS = ["Score", "LABELS", "Spans", "slot", "Component_ID", "fp"]  # replaced where an operator gives them


@pytest.fixture(scope="module")
def clashing(spark, rows):
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(AWKWARD)], *[F.lit("x").alias(c) for c in RESULTS]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int("!!" not in (r[1] or "x")), int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 90], "doc_id long, quality int, toxic int")


def applied(name, df, labels):
    if name == "licenses":
        return licenses.scan(df)
    if name == "mixing":
        return mixing.mix(df)
    if name == "language":
        return language_id.classify(df, language_id.train(df))
    if name == "bpe":
        return bpe_reuse.decode(bpe_reuse.encode(df))
    if name == "simhash":
        return simhash.classes(simhash.fingerprints(df), "doc_id")
    if name == "quality":
        return quality_rules.rules(df)
    if name == "rules":
        return rule_ensemble.score(df, rule_ensemble.train(df, labels))
    if name == "toxicity":
        return toxicity.score(df, *toxicity.train(df, labels))
    return dac_file.read(dac_file.write(df))


OPERATORS = ["licenses", "mixing", "language", "bpe", "simhash", "quality", "rules", "toxicity", "files"]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_empty_tables_and_nulls(name, clashing, labels, rows):
    out = applied(name, clashing, labels)
    assert out.count() == len(rows)
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower)
    if name != "files":
        assert {"doc_id", "text", "lang", "source", *AWKWARD} <= set(out.columns) | ({"rank"} if name == "mixing" else set())
        kept = out.select(*["`" + c.replace("`", "``") + "`" for c in AWKWARD]).distinct().collect()
        assert [list(r) for r in kept] == [list(range(len(AWKWARD)))]
    assert applied(name, clashing.limit(0), labels.limit(0)).count() == 0
    nulls = clashing.limit(5).select(*[F.lit(None).cast(t).alias(c) for c, t in clashing.dtypes])
    assert applied(name, nulls, labels).count() == 5


def test_vectors_with_clashing_names_empty_tables_and_nulls(spark):
    names = ["rep", "copies", "h", "dim", "cell", "both", "own", "x", "y", "n_links", "Component_ID", "kept", "v", "id", "halvings", "a.b"]
    rows = [(k, [1.0, float(k % 3), 0.5], 1) for k in range(12)] + [(12, None, 1), (13, [0.0, 0.0, 0.0], 1), (14, [None, 1.0, 1.0], 1), (15, [1.0, 0.0, 0.5], None), (None, [1.0, 0.0, 0.5], 1), (3, [1.0, 0.0, 0.5], 1), (16, [1.0, 0.0], 1), (17, [], 1), (18, [float("nan"), 1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got = collision.link(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["vec_id"], []).append(r)
    assert [by[k][0]["n_links"] for k in (0, 6, 9)] == [4, 4, 4] and [by[k][0]["n_links"] for k in (1, 2)] == [3, 3]
    assert sorted(r["n_links"] for r in by[3]) == [4, 4] and all(by[k][0]["n_links"] == 0 and by[k][0]["kept"] for k in (12, 13, 14, 15, 16, 17, 18, None))
    assert by[9][0]["component_id"] == 0 and by[7][0]["component_id"] == 1
    assert collision.link(df.limit(0)).count() == 0
    assert collision.link(df.limit(4).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])).count() == 4


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, clashing, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
            assert not docs.isEmpty()
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
