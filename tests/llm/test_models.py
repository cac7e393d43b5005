"""Classifiers on held-out rows and awkward ones (4, 8, 9), and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from quire.llm import bpe_reuse, language_id, mixing, rule_ensemble, simhash, toxicity
from quire.llm.common import crc_mod


def held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 0


@pytest.fixture(scope="module")
def labels(spark, rows):
    made = [(r[0], int("!!" not in (r[1] or "x")), int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 90]
    return spark.createDataFrame([*made, (None, 1, 1), (3, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")


OTHER = ["Привет, мир, как дела сегодня в этом большом городе " * 5, "中文文本在这里，我们说中文。", "Ελληνικά γράμματα εδώ και εκεί"]


def test_language(spark, docs, rows, empty):
    kernel = language_id.train(docs.filter(crc_mod("doc_id", 4) != 2))
    got = language_id.classify(docs, kernel).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 120:
            assert r["lang_pred"] == r["lang"], r
        if r["doc_id"] in (120, 121, 122, 123):
            assert r["lang_pred"] == "und"
    other = spark.createDataFrame([(k, t) for k, t in enumerate(OTHER)], "doc_id int, text string")
    assert all(r["likeness"] < 0.06 for r in language_id.classify(other, kernel).collect())
    assert all(r["likeness"] > 0.1 for r in got if r["doc_id"] is not None and r["doc_id"] < 120)
    assert not any(map(language_id.has_letter, ("½ ² 12", "", None))) and language_id.has_letter("1 ª")
    assert language_id.train(empty) is None
    assert language_id.classify(empty, None).count() == 0
    assert {r["lang_pred"] for r in language_id.classify(docs.limit(3), None).collect()} == {"und"}


def test_presence_equals_sets_of_ngrams():
    texts = ["abcab", "", "Äb", "a" * 50, "bca cab"]
    found = language_id.presence(texts, 3, 1 << 16)
    for t, row in zip(texts, found, strict=True):
        t = t.lower()
        grams = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
        assert row.sum() == len(grams)
    both = {texts[0][i : i + n] for n in (1, 2, 3) for i in range(5 - n + 1)} & {texts[4][i : i + n] for n in (1, 2, 3) for i in range(7 - n + 1)}
    assert int(found[0].astype(int) @ found[4]) == len(both)


def test_rules(docs, labels, rows, empty):
    model = rule_ensemble.train(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in rule_ensemble.score(docs, model, prefix="q_").collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert 0 <= r["q_score"] <= 1 and r["score"] == 0.5
        z = np.array([rule_ensemble.statistics(text)])
        total = model.intercept + sum(w for rule, w in model.rules if rule_ensemble.holds(rule, z)[0])
        if i is not None and (text or "") == (r["text"] or ""):
            assert r["q_score"] == pytest.approx(1 / (1 + np.exp(-total)))
        if i is not None and i < 90 and held(i, 5):
            assert r["q_predicted"] == int("!!" not in text)
    assert rule_ensemble.train(docs, labels.filter("quality = 1")).rules == []
    assert rule_ensemble.score(empty, model).count() == 0


DISGUISED = {"1d10t": "idiot", "s c u m": "scum", "i.d.i.o.t": "idiot", "sccccum": "scum", "$cum!": "scum", "ID10T": "idiot"}


def test_toxicity(spark, docs, labels, rows, empty):
    model, lexicon = toxicity.train(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    got = toxicity.score(docs, model, lexicon, prefix="t_").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["t_score"] <= 1 and r["score"] == 0.5
        assert r["t_predicted"] == int("idiot" in (r["text"] or "")), r["doc_id"]
    hidden = spark.createDataFrame([(k, f"the {w} and") for k, w in enumerate(DISGUISED)], "doc_id int, text string")
    assert [r["matched"] for r in toxicity.score(hidden, model, lexicon).orderBy("doc_id").collect()] == [[w] for w in DISGUISED.values()]
    _, none = toxicity.train(empty, labels)
    assert none.score(set()) == pytest.approx(0.5)


SPACED = {"you are a i d i o t": "idiot", "s c u m i d i o t": "idiot scum", "i d i o t!": "idiot", "i d i o t, and": "idiot", "( s c u m )": "scum", "s c u m !": "scum", "an i d ! o t": "idiot"}


def test_spaced_words_are_found_beside_others(docs, labels):
    model, _ = toxicity.train(docs, labels)
    decoder = toxicity.Decoder(model)
    for text, words in SPACED.items():
        assert set(words.split()) <= toxicity.words_of(f"the {text} and", decoder), text
    assert "scum" not in toxicity.words_of("a b c d e f g", decoder)


GATED = {"iiddiioott": "idiot", "idiiot": "idiot", "idіоt": "idiot", "!diot": "idiot", "|diot": "idiot", '"!diot"': "idiot", "1d107": "idiot", "5cum": "scum", "$(um": "scum"}


def test_disguises_of_the_lattice_are_decoded(docs, labels):
    model, _ = toxicity.train(docs, labels)
    decoder = toxicity.Decoder(model)
    missed = [token for token, word in GATED.items() if word not in toxicity.words_of(f"the {token} and", decoder)]
    assert missed == []
    assert all(decoder.token(t) == () for t in ("455", "12:30", "the", "3.5%", "сказал"))


def test_trigram_counts_cover_all_texts(docs, rows):
    counts = {r["gram"]: r["n"] for r in toxicity.trigrams(docs).collect()}
    total, codes = np.zeros(toxicity.SIZE**3, np.int64), toxicity.letter_codes()
    for r in rows:
        toxicity.count_trigrams([r[1]], codes, total)
    letters = [g for g in counts if min(g % toxicity.SIZE, g // toxicity.SIZE % toxicity.SIZE, g // toxicity.SIZE**2) > 0]
    assert letters and all(counts[g] == total[g] for g in letters)


def test_viterbi_is_the_cheapest_path():
    import itertools

    rng = np.random.default_rng(0)
    decoder = toxicity.Decoder(toxicity.Model(rng.integers(0, 50, toxicity.SIZE**3)))
    for token in ("1d0t", "s-c.m", "aab1", "x@!"):
        best = min((sum(c for _, c in path) + spell(decoder, "".join(x for x, _ in path)), "".join(x for x, _ in path)) for path in itertools.product(*[decoder.options(token, i) for i in range(len(token))]))
        assert decoder.viterbi(token) == best[1]


def test_long_tokens_take_time_in_proportion():
    import time

    decoder, took = toxicity.Decoder(toxicity.Model(np.random.default_rng(0).integers(0, 50, toxicity.SIZE**3))), []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert len(decoder.viterbi("ab1c" * (n // 4))) == n
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0]


def spell(decoder, letters):
    a = b = total = 0
    for ch in letters:
        c = decoder.code.get(ch, 1)
        total, a, b = total + decoder.cost[a][b][c], b, c
    return total + decoder.cost[a][b][0]


def test_pipeline(spark, rows, labels, tmp_path):
    plain = [r[:5] for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(plain, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), plain
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / f"stage{k}"))
            out = spark.read.parquet(str(tmp_path / f"stage{k}"))
            got = Counter(map(tuple, out.collect()))
        if k == 0:
            seen = language_id.classify(docs, language_id.train(docs)).collect()
            want = Counter(tuple(r)[:5] for r in seen if language_id.has_letter(r["text"]) and r["likeness"] >= 0.06)
            assert sum(want.values()) >= len([r for r in kept if language_id.has_letter(r[1])]) - 3
            assert got == want
        elif k == 1:
            model = rule_ensemble.train(docs, labels)
            z = np.array([rule_ensemble.statistics(r[1]) for r in kept])
            total = model.intercept + sum(w * rule_ensemble.holds(rule, z) for rule, w in model.rules)
            want = Counter(r for r, t in zip(kept, total, strict=True) if 1 / (1 + np.exp(-t)) >= 0.3)
            assert got == want and not any("!!" in r[1] for r in got)
        elif k == 2:
            value = {r: simhash.fingerprint(r[1]) for r in kept}
            groups = []
            for r in sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0)):
                hit = [g for g in groups if any((value[r] ^ value[x]).bit_count() <= 3 for x in g)]
                groups = [g for g in groups if g not in hit] + [[x for g in hit for x in g] + [r]]
            want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups)
            assert got == want
        elif k == 3:
            assert got == Counter(kept)
            order = mixing.mix(docs, prefix="x_")
            first = [r["doc_id"] for r in order.orderBy("x_position").collect()]
            files = sorted((tmp_path / "stage3").glob("*.parquet"))
            assert [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).collect()] == first
        else:
            made = bpe_reuse.ChunkEncoder(bpe_reuse.default_path())
            assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {r[0]: len(made.encode([r[1]])[0]) for r in kept}
            assert out.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
        if k < 4:
            docs, kept = out, list(got.elements())


def test_dedup_keeps_one_row_of_every_class(spark):
    text = {k: " ".join(f"{k}{i * i}" for i in range(60)) for k in "abcdefg"}
    rows = [(None, text["a"], "x"), (None, text["b"], "x"), (None, text["b"], "y"), (None, text["c"], "x"), (None, text["c"], "x"), (1, text["c"], "x")]  # c has an id
    rows += [(2, text["d"], "x"), (2, text["e"], "x"), (2, text["e"], "x"), (3, text["f"], "x"), (3, text["f"], "y"), (4, text["f"], "x"), (None, text["g"], None), (None, text["g"], None)]
    out = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "")
    assert out.columns == ["doc_id", "text", "source"]
    got = [tuple(r) for r in out.collect()]
    assert Counter(r[:2] for r in got) == Counter([(None, text["a"]), (None, text["b"]), (1, text["c"]), (2, text["d"]), (2, text["e"]), (3, text["f"]), (None, text["g"])])
    assert set(got) <= set(rows)


def test_a_worker_keeps_the_caches_of_one_operator(spark, tmp_path):
    from quire.llm import common

    def kept():
        return len(common._HELD)

    path = bpe_reuse.default_path()
    made = common.begun(lambda: bpe_reuse.chunk_encoder(path))
    assert made is common.begun(lambda: bpe_reuse.chunk_encoder(path)) and kept() == 1
    common.begun(lambda: len)  # a task of an operator that keeps nothing
    assert kept() == 0 and bpe_reuse.chunk_encoder(path) is not made
    common.held(("other", 1), dict)
    assert list(common._HELD) == [("other", 1)]
    common.let_go()
    # In a real worker: the tasks after those of the encoder find nothing of it.
    docs = spark.createDataFrame([(k, f"some text {k}") for k in range(8)], "doc_id long, text string").coalesce(1)
    schema = T.StructType([T.StructField("n", T.LongType())])

    def look():
        from quire.llm import common

        return lambda texts: [[len(common._HELD)] * len(texts)]

    assert bpe_reuse.digests(docs).count() == 8
    assert {r["n"] for r in common.map_texts(docs, "text", schema, look).collect()} == {0}
