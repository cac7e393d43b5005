"""Operators on single texts against plain restatements: 1, 5, 7 and 10."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe_reuse, dac_file, licenses, quality_rules


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


LICENSED = [
    "x. Licensed under the MIT License. y under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "Licensed under the Apache Lisence, Verson 2", "This work is licensed under the GNU Genral Public License",
    "Permission is hereby grantd, free of charg, to any persn", "nothing of the kind under the tree", "under the mit", None, "",
]


def test_license_scan(spark, docs, empty):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id int, text string")
    got = {i: r[0] for i, r in by_id(licenses.scan(df)).items()}
    assert [got[i]["labels"] for i in range(10)] == ["mit", "apache-2", "cc-by-nc", "apache-2", "gpl", "mit", "", "", "", ""]
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (11, 2, 2, 7)
    assert got[3]["n_base"] == 0 and got[3]["first_word"] is None and 0.8 < got[3]["score"] < 1 and got[3]["spans"][0]["edits"] == 3
    for i, text in enumerate(LICENSED):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(k, lab) for p, lab in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert got[i]["n_words"] == len(words) and got[i]["n_base"] == len(places)
        assert got[i]["base_labels"] == ",".join(sorted({lab for _, lab in places}))
    assert licenses.scan(empty).count() == 0
    every = licenses.scan(docs)
    assert every.count() == docs.count() and all(0 <= r["score"] <= 1 for r in every.collect())


def spoil(rng, text, errors):
    chars = list(text)
    for _ in range(errors):
        k = rng.randrange(1, len(chars) - 1)
        act = rng.choice("dis")
        chars[k : k + 1] = [] if act == "d" else [chars[k], rng.choice("abq")] if act == "i" else [rng.choice("abq")]
    return "".join(chars)


def test_fuzzy_loses_no_match_of_a_search_of_the_whole_text():
    import regex

    scanner, rng, seen = licenses.Scanner(), random.Random(3), 0
    plain = {n.text: regex.compile(f"(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}") for n in scanner.notices}
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice(scanner.notices)
            parts += [spoil(rng, n.text, rng.randint(0, n.errors)), " ".join(rng.choice(["the", "under", "license", "foo", "by", "cc"]) for _ in range(rng.randint(0, 4)))]
        text = f" {' '.join(' '.join(parts).split())} "
        spans = scanner.fuzzy(text)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        for n in scanner.notices:
            for m in plain[n.text].finditer(text):
                if n.told(text, m.start(), m.end()):
                    seen += 1
                    assert any(a < m.end() and m.start() < b for a, b, _, _ in spans), (text, m)
    assert seen > 300


def test_no_match_with_glued_edges_is_lost():
    """Words joined to each other and to their neighbours, against the operator's own pattern at every place."""
    scanner, rng, seen = licenses.Scanner(), random.Random(8), 0
    assert [x["label"] for x in scanner.scan("xpermission ishereby grantedfree ofcharge toany personx")[7]] == ["mit"]
    fill = ["alpha", "of", "the", "license", "version", "and", "public"]
    for _ in range(3000):
        n = rng.choice(scanner.notices)
        chars = list(n.text)
        for _ in range(rng.randint(0, n.errors)):
            gaps, k, act = [i for i, c in enumerate(chars) if c == " "], rng.randrange(len(chars)), rng.random()
            if act < 0.4 and gaps:
                del chars[rng.choice(gaps)]
            elif act < 0.6:
                del chars[k]
            else:
                chars[k : k + 1] = [rng.choice("abt ")] + [chars[k]] * (act > 0.8)
        sides = [" ".join(rng.choice(fill) for _ in range(rng.randint(0, 5))) for _ in "ab"]
        text = f" {' '.join((sides[0] + rng.choice(['', ' ', 'x']) + ''.join(chars) + rng.choice(['', ' ', 'x']) + sides[1]).split())} "
        hits = [m for at in range(len(text)) if (m := n.pattern.match(text, at)) and n.told(text, m.start(), m.end())]
        if hits:
            seen += 1
            spans = scanner.fuzzy(text)
            assert all(any(a < m.end() and m.start() < b for a, b, _, _ in spans) for m in hits), text
    assert seen > 1000


def test_license_scan_of_text_full_of_seeds():
    import time

    scanner = licenses.Scanner()
    for seed in ("license ", "version 2 ", "the ", "cc by "):
        began = time.process_time()
        scanner.scan(seed * (400_000 // len(seed)))
        assert time.process_time() - began < 4, seed


TELLING = {"licensed under cc by nc sa": "cc-by-nc,cc-by-nc-sa", "licensed under cc by 4 0": "cc-by", "licensed under cc by sa 4 0": "cc-by-sa", "under the isc license": "isc", "under the bsd license": "bsd", "undr the isc licence": "isc", "licnsed under cc by nc": "cc-by-nc", "under the xyz license": "", "apache license version 1": ""}


def test_edits_never_touch_the_words_that_tell_licenses_apart():
    scanner = licenses.Scanner()
    assert {t: scanner.scan(t)[5] for t in TELLING} == TELLING


def test_license_scan_takes_time_in_proportion():
    import time

    scanner, took = licenses.Scanner(), []
    for n in (2000, 8000):
        text = "Licensed under the MIT licence, Apache License Version 2. " * n
        began = time.process_time()
        got = scanner.scan(text)
        took.append(time.process_time() - began)
        assert len(got[7]) == 2 * n and got[7][-1]["last_word"] == got[0] - 1
    assert took[1] < 8 * took[0]


def test_bpe_round_trip(docs, rows, empty):
    tokenizer = Tokenizer.from_file(bpe_reuse.default_path())
    got = by_id(bpe_reuse.digests(docs, keep=["doc_id"]))
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want for r in got[i])
    texts = by_id(bpe_reuse.decode(bpe_reuse.encode(docs.select("doc_id", "text")).limit(50)))
    known = {r[0]: r[1] or "" for r in rows}
    assert all(r["decoded"] == known[i] for i, some in texts.items() for r in some)
    assert bpe_reuse.digests(empty).count() == 0


def library_ids(made, text):
    return made.base.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_are_shared_and_joins_exact():
    made = bpe_reuse.ChunkEncoder(bpe_reuse.default_path())
    rng = random.Random(1)
    shared = " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 12))) for _ in range(800))
    texts = [shared, "q" + shared, shared[5:] + "\n\nend", "x" * 3000, shared.replace(" ", ""), "", None]
    found = made.encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert list(ids) == library_ids(made, text)
        assert made.decode(ids) == (text or "")
    assert made.reused > 10 and made.encoded == len(made.chunks)
    before = made.encoded
    assert [list(x) for x in made.encode(texts)] == [list(x) for x in found] and made.encoded == before


def test_joins_are_repaired_until_ids_agree(monkeypatch):
    made = bpe_reuse.ChunkEncoder(bpe_reuse.default_path())
    rng = random.Random(5)
    kinds = ["abcdefghij", "aeiou ", "ab'stre ", "0123456789", "0a ", "  \n\t a", "日本語の本 ", "éàüß", "'", "-_!' s", "<|endoftext|> ", "хорошо ", "١٢٣ a", "😀🎉 a", "e\u0301a "]
    texts = ["".join(rng.choice(rng.choice(kinds[k : k + 2] or kinds)) for _ in range(rng.randint(1, 700))) for k in range(len(kinds)) for _ in range(12)]
    texts += ["the international" * 40, "don't" * 300, " " * 900, "a" * 900 + " " * 90, "internationalization" * 300]
    for cut in (3, 17, 90):  # chunks of any bytes, also where no mark is
        monkeypatch.setattr(bpe_reuse, "cuts", lambda data, cut=cut: [e for e in range(cut, len(data), cut) if data[e] & 0xC0 != 0x80] + [len(data)] if data else [])
        made.chunks.clear()
        for text, ids in zip(texts, made.encode(texts), strict=True):
            assert list(ids) == library_ids(made, text), (cut, text)
    assert made.grown > 5 and made.welds > 1000


def test_long_texts_without_spaces_are_cut_and_bounded():
    made = bpe_reuse.ChunkEncoder(bpe_reuse.default_path())
    rng = random.Random(2)
    text = "".join(rng.choices("etaoinshrdlu", k=300_000))
    assert list(made.encode([text])[0]) == library_ids(made, text)
    data = text.encode() + b"\0" * 3_000_000 + "日".encode() * 10_000
    ends = bpe_reuse.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= bpe_reuse.MOST for a, b in zip([0, *ends], ends, strict=False))
    assert b"".join(data[a:b] for a, b in zip([0, *ends], ends, strict=False)) == data and all(data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False))
    shifted = bpe_reuse.cuts(b"some other start" + text.encode())
    assert len({e - 16 for e in shifted} & set(ends)) > 300  # cuts follow the content


def test_quality_rules(docs, rows, empty):
    got = by_id(quality_rules.rules(docs, keep=["doc_id"]))
    for i, text, *_ in rows:
        if i in (124,):
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        count = Counter(windows)
        marked = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")))
            assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(marked))
            assert r["base_failed"] == (len(words) < 20 or 100 * len(marked) > 30 * len(words))
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.rules(empty).count() == 0


def kept(spark, datas, limits):
    df = spark.createDataFrame([(k, d.decode("latin-1")) for k, d in enumerate(datas)], "doc_id int, text string")
    return {r["doc_id"]: r for r in quality_rules.rules(df, limits=limits).collect()}


def prose_of(rng, n):
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(1500)]
    return " ".join(words[int(1500 * rng.random() ** 3)] for _ in range(n)).encode()


def test_bands_are_calibrated_on_distinct_texts_and_find_noise_and_repetition(spark):
    import base64
    import os

    rng = random.Random(3)
    clean = prose_of(rng, 30_000)
    some = [clean[k : k + rng.choice([300, 700, 1500, 2500, 4096, 6000])] for k in (rng.randrange(len(clean) - 6000) for _ in range(1200))]
    hot = [clean[:900]] * 800  # copies count once
    df = spark.createDataFrame([(d.decode(),) for d in some + hot], "text string")
    limits = quality_rules.calibrate(quality_rules.measure(df))
    for n in (300, 1000, 4096):
        k = int(np.log2(n) * quality_rules.STEPS)
        usual = np.median([quality_rules.ratios(clean[a : a + n], __import__("zstandard").ZstdCompressor(3).compress)[0] for a in range(0, 50_000, 1000)])
        assert limits.low[k] < usual < limits.high[k] < 1.6 * usual
    noise = base64.b64encode(os.urandom(120_000))
    noisy = lambda share: clean[: int(120_000 * (1 - share))] + b" " + noise[: int(120_000 * share)]
    spaced = lambda d: b" ".join(d[i : i + 8] for i in range(0, len(d), 8))
    got = kept(spark, [clean[5000:6500], clean[:100_000], b"ab " * 40, spaced(noise[:900]), noisy(0.2), noisy(0.85), b" ".join(w + b"&&& %%%" for w in clean[:3000].split()), clean[:3000] + prose_of(random.Random(8), 30) * 400], limits)
    assert [got[k]["kept"] for k in range(8)] == [True, True, False, False, False, False, False, False]
    assert got[4]["bad_chunks"] >= 4 and not got[4]["base_failed"] and not got[6]["base_failed"]


def test_fixed_bands_hold_where_nothing_can_be_calibrated(spark, docs, empty):
    assert quality_rules.calibrate(quality_rules.measure(empty)).high == quality_rules.Limits.fixed().high
    import os

    got = kept(spark, [b"", prose_of(random.Random(1), 300), os.urandom(9000)], None)
    assert [got[k]["kept"] for k in range(3)] == [False, True, False]


def test_long_repetitive_texts_take_memory_in_proportion():
    words = [b"a", b"b", b"c"] * 400_000
    assert quality_rules.repeated_words(words) == len(words)


def test_token_files(spark, docs, rows, empty):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = dac_file.write(docs, shard_tokens=5000)
    got = dac_file.read(manifest).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (i, text, *_) in zip(got, ordered, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert dac_file.read(dac_file.write(empty)).count() == 0
    with pytest.raises(ValueError):
        dac_file.Shard.load(b"something else")
    first = manifest.orderBy("part", "shard").first()
    stored = dac_file.Shard.open(first["uri"])
    assert stored.n_tokens == first["n_tokens"] and [stored.token(p) for p in range(50)] == stored.tokens(0, 50).tolist()
    with pytest.raises(TypeError):
        dac_file.write(docs.withColumn("doc_id", docs["text"]))


def test_rows_of_one_id_are_dealt_out(spark):
    df = spark.range(4000).selectExpr("7L doc_id", "concat('text ', id) text")
    manifest = dac_file.write(df)
    assert manifest.count() > 2 and dac_file.read(manifest).filter("doc_id = 7").count() == 4000


def test_random_access():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2**rng.integers(1, 32, 5000), 5000).astype("<u4")
    sizes = [0, 1, 4000, 999]
    shard = dac_file.Shard.load(dac_file.dump(range(4), sizes, ids))
    assert [shard.token(p) for p in range(5000)] == ids.tolist()
    assert np.array_equal(np.concatenate([shard.document(k) for k in range(4)]), ids)
    assert np.array_equal(shard.tokens(777, 3333), ids[777:3333])
    assert shard.n_tokens == 5000


def test_uncommon_white_space_stays_within_the_method():
    import random

    rng = random.Random(4)
    made = bpe_reuse.ChunkEncoder(bpe_reuse.default_path())
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(6000))
    made.encode([base])
    before = made.encoded
    text = base[:20_000] + "\u00a0\u3000 " + base[20_000:]
    assert made.encode([text])[0].tolist() == made.base.tokenizer.encode(text, add_special_tokens=False).ids
    assert made.encoded - before < 5 and made.reused > 40
    for _ in range(300):
        text = "".join(rng.choice(["word ", " ", "x.", "\u00a0", "\x0b", "\u2003", "\n", "12", "é", "  ", "'s"]) for _ in range(rng.randint(100, 900)))
        assert made.encode([text])[0].tolist() == made.base.tokenizer.encode(text, add_special_tokens=False).ids


def test_copies_of_a_row_fill_many_ranges(spark):
    rows = spark.range(40_000).selectExpr("5L doc_id", "'same text' text").repartition(8)
    manifest = dac_file.write(rows)
    assert manifest.agg(F.countDistinct("part"), F.sum("n_docs"), F.max("n_docs")).first()[:2] == (8, 40_000)
    got = dac_file.read(manifest)
    assert got.agg(F.count("*"), F.countDistinct("start"), F.countDistinct("ids_crc32")).first()[:] == (40_000, 40_000, 1)


def test_new_units_go_to_the_library_in_joined_texts():
    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeöéÄ'7$.") for _ in range(rng.randint(1, 9)))
    text = "".join(word() + rng.choice([" ", " ", ", ", ".\n", "...  ", ";x", "!?\t", ",'s ", "$. ", "7,", "\r\n\n"]) for _ in range(6000))
    made = bpe_reuse.ChunkEncoder(bpe_reuse.default_path())
    made.base.tokenizer = counted = Counted(made.base.tokenizer)
    want = counted.inner.encode(text, add_special_tokens=False).ids
    made.split([text.encode()])
    assert counted.texts < 1000  # before, one for each of more than 5,000 unlike units
    assert made.encode([text])[0].tolist() == want
    for one in text.split("\n")[:200]:
        assert made.encode([one])[0].tolist() == counted.inner.encode(one, add_special_tokens=False).ids
