"""The registered queries on a small folder of tables: columns, rows and what their contracts fix."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import registry

COLUMNS = {
    "op1_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op2_pfair_mix": ["doc_id", "source", "rank", "block", "slot", "release", "deadline", "position"],
    "op3_collision_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_bpe_chunk_reuse": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_quality_bands": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_rule_ensemble": ["doc_id", "held_out", "score", "predicted"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}
THRESHOLDS = {"op8_rule_ensemble": 0.3, "op9_toxicity": 0.5}


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = [r[:5] for r in rows]
    labels = [(r[0], int("!!" not in (r[1] or "")), int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 90]
    rng = np.random.default_rng(1)
    center = rng.standard_normal((4, 16))
    vectors = [(k, (center[k % 4] + 0.05 * rng.standard_normal(16)).tolist(), None if k == 7 else k % 2) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), vectors


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, rows, folder, name):
    path, vectors = folder
    df = registry.queries()[name](spark, path)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = df.collect()
    texts = {r[0]: r[1] or "" for r in rows}
    if name == "op3_collision_dedup":
        unit = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in vectors}
        label = {k: x for k, _, x in vectors}
        for r in got:
            k = r["vec_id"]
            links = [j for j in unit if j != k and label[k] is not None and label[j] == label[k] and unit[j] @ unit[k] >= 0.98]
            assert r["n_links"] == len(links) and r["kept"] == (r["component_id"] == k)
        assert len(got) == len(vectors)
        return
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    if "held_out" in df.columns:
        n, rest = (4, 2) if name == "op4_language_id" else (5, 0)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in got)
    if name in THRESHOLDS:
        assert all(r["predicted"] == int(r["score"] >= THRESHOLDS[name]) for r in got)
    if "score" in df.columns:
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "op5_bpe_chunk_reuse":
        assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
    if name == "op6_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)
        assert {r["component_id"] for r in got if r["doc_id"] in range(100, 105)} == {2}
    if name == "op10_token_files":
        ordered = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
        assert [r["doc_id"] or -1 for r in ordered] == sorted(r["doc_id"] or -1 for r in ordered)
