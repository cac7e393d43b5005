"""Operators on pairs and orders against brute force: 2, 3 and 6."""

import os
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import collision, mixing, simhash
from quire.llm.common import components, join_dealt


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(k) for k in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    fps = simhash.fingerprints(docs, keep=["doc_id"])
    got = simhash.classes(fps, "doc_id").collect()
    assert len(got) == len(rows)
    values = [brute_fingerprint(r[1]) if len(r[1] or "") < 100_000 else simhash.fingerprint(r[1]) for r in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3])
    low = {k: min((rows[j][0] for j in range(len(rows)) if root[j] == k and rows[j][0] is not None), default=None) for k in set(root)}
    want = Counter((r[0], values[k], low[root[k]]) for k, r in enumerate(rows))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.classes(simhash.fingerprints(empty, keep=["doc_id"]), "doc_id").count() == 0


def test_links_find_all_near_fingerprints_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(25)]
    fps = sorted({*near, *map(int, rng.integers(0, 2**63, 200, dtype=np.int64)), 0, 7})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for block in (4, 2048):
        got = {r["node"]: r["component"] for r in components(simhash.links(df, block=block)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[k] for k in want]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components(df.limit(0)).count() == 0


def test_collision_dedup(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(8):
            center = rng.standard_normal(32)
            for _ in range(int(rng.integers(1, 14))):
                rows.append((n, (center + rng.standard_normal(32) * rng.choice([0.05, 0.12, 0.2])).tolist(), label))
                n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(6)] + [(n + 6, rows[0][1], 1), (n + 6, rows[0][1], 1)]
    rows += [(n + 10, None, 0), (n + 11, [0.0] * 32, 0), (n + 12, [float("nan")] * 32, 0), (n + 13, rows[0][1], None), (n + 14, [None, 1.0], 0), (n + 15, [1.0], 0), (n + 16, [float("inf"), 1.0], 0), (n + 17, [2.0], 0), (n + 18, [1e-200], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1)).withColumn("rep", F.lit("x"))

    def usable(v):
        return v is not None and None not in v and np.isfinite(v).all() and np.any(v)

    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if usable(v) and label is not None else None for _, v, label in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root, links = roots(len(rows), pairs), Counter(x for p in pairs for x in p)
    low = {k: min(rows[j][0] for j in range(len(rows)) if root[j] == k) for k in set(root)}
    want = Counter((r[0], links[k], low[root[k]], r[0] == low[root[k]]) for k, r in enumerate(rows))
    for cell in (8, 2048):
        got = Counter(tuple(r) for r in collision.link(df, cell=cell, loss=1e-6).collect())
        assert got == want, (cell, got - want, want - got)
    assert collision.link(df.limit(0)).count() == 0
    assert collision.calibrate(16, 3.0, 0.9999) < 16 and collision.calibrate(16, 9.0, 0.9999) == 16


def test_cells_keep_near_pairs_of_a_large_label_and_count_them_once(spark):
    rng = np.random.default_rng(3)
    center = rng.standard_normal((2500, 24))
    vectors = np.concatenate([center, center[:1500] + 0.12 * rng.standard_normal((1500, 24)), center[:300] + 0.1 * rng.standard_normal((300, 24))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").selectExpr("*", "1 label")
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in collision.link(df, cell=128).collect()}
    found = np.array([got[k] for k in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and links.sum() > 1000


@pytest.mark.skipif("QUIRE_SLOW" not in os.environ, reason="several minutes; set QUIRE_SLOW")
def test_recall_on_a_large_label(spark):
    """50,000 vectors of one label with pairs around the least cosine, against all pairs by blocks."""
    rng = np.random.default_rng(5)
    center = rng.standard_normal((38_000, 32))
    near = center[:12_000] + rng.uniform(0.1, 0.22, (12_000, 1)) * rng.standard_normal((12_000, 32))
    vectors = np.concatenate([center, near]).astype(np.float32)
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = np.concatenate([(unit[s : s + 1000] @ unit.T >= 0.98).sum(1) - 1 for s in range(0, len(unit), 1000)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").selectExpr("*", "1 label").repartition(8)
    got = {r["vec_id"]: r["n_links"] for r in collision.link(df).collect()}
    found = np.array([got[k] for k in range(len(vectors))])
    print(found.sum(), links.sum())
    assert (found <= links).all() and links.sum() > 5000 and found.sum() >= 0.999 * links.sum()


def test_sorted_lines_find_what_counting_all_pairs_finds():
    rng = np.random.default_rng(2)
    center = rng.standard_normal((300, 20))
    vectors = np.concatenate([center, center[:200] + 0.1 * rng.standard_normal((200, 20)), center[:3]])
    unit, rays, need = vectors / np.linalg.norm(vectors, axis=1)[:, None], collision.lines(20), collision.calibrate()
    half = 3.0 * np.sqrt(0.04) + 1e-6
    for a, b in ((unit, unit), (unit[:150], unit[150:])):
        p, q = (a @ rays).astype(np.float32), (b @ rays).astype(np.float32)
        hits = (np.abs(p[:, None, :] - q[None, :, :]) <= np.float32(half)).sum(2)
        want = set(zip(*np.nonzero((hits >= need) & (a @ b.T >= 0.98)), strict=True))
        for most in (1 << 20, 500):
            collision.PAIRS, before = most, collision.PAIRS
            got = list(zip(*collision.near(a, b, 0.98, need, rays, 3.0), strict=True))
            collision.PAIRS = before
            assert set(got) == want and len(got) == len(want)


def test_zones_lose_no_more_than_allowed():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(400_000)
    y = x + 0.2 * rng.standard_normal(len(x))
    half = collision.zone(0.2, 0.4, 1e-3) / 2
    apart = (np.minimum(x, y) < -half) & (np.maximum(x, y) > half)
    assert 0 < apart.mean() < 1.3e-3
    counts = np.bincount(np.clip((rng.standard_normal(100_000) + 4) * 64, 0, 511).astype(int), minlength=512)
    ((_, place, half),) = collision.choose_cuts(counts[None], 0.2, 1e-4)
    assert abs(place) < 0.6 and 0 < half < 0.6


def test_many_links_of_a_node_or_key_are_dealt_out(spark):
    pairs = spark.range(1, 3000).selectExpr("0L a", "id b").union(spark.range(3000, 3010).selectExpr("id a", "id + 1 b"))
    got = {r["node"]: r["component"] for r in components(pairs, hot_rows=100).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(3000, 3011), 3000)}
    rows = spark.range(4000).selectExpr("id", "if(id % 4 = 0, id, 7L) k")
    other = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    joined = join_dealt(rows, other, ["k"], "n", 4000, hot_rows=100)
    assert {(r["id"], r["x"]) for r in joined.collect()} == {(k, 2 * (k if k % 4 == 0 else 7)) for k in range(4000)} and joined.columns == ["k", "id", "x"]


def test_copies_of_one_fingerprint_and_one_vector(spark):
    docs = spark.range(100_000).selectExpr("id doc_id", "if(id % 3 = 0, 0L, id * 2654435761) fp", "id component_ID")
    got = simhash.classes(docs, "doc_id")
    assert got.columns == ["doc_id", "fp", "component_id"]
    assert got.filter("fp = 0").agg(F.count("*"), F.min("component_id"), F.max("component_id")).first()[:] == (33_334, 0, 0) and got.count() == 100_000
    same = spark.range(100_000).selectExpr("id vec_id", "if(id % 3 = 0, array(1f, 2f), array(float(-id), 1f / (id + 1))) embedding", "1 label")
    top = collision.link(same.filter("vec_id % 3 = 0 or vec_id < 50")).filter("n_links > 1000").agg(F.count("*"), F.min("component_id"), F.max("component_id")).first()
    assert top[:] == (33_334, 0, 0)


def checked_lags(order, weights):
    """Shares kept within one block of the asked weights until a source has no block left."""
    left, seen = Counter(order), Counter()
    total = sum(weights[s] for s in left)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * weights[x] / total) < 1 for x in left), (t, s)
        if any(seen[x] == left[x] for x in left):
            return t


def slots_of(got):
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
        assert r["release"] <= r["slot"] < r["deadline"]
    assert sorted(slots) == list(range(len(slots)))
    return [slots[k] for k in range(len(slots))]


def test_mixing(docs, rows, empty):
    for weights in (None, {"a": 3, None: 0.7, "c": 1}):
        got = mixing.mix(docs, block=2, weights=weights).orderBy("position").collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        assert {"text", "score", "fp", "component_id"} <= set(got[0].asDict())
        asked = {None: Fraction(1), "a": Fraction(1), "b": Fraction(1), "c": Fraction(1)} | {k: Fraction(str(v)) for k, v in (weights or {}).items()}
        assert checked_lags(slots_of(got), asked) >= 2
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.withColumnRenamed("rank", "Position")).columns[-1] == "position"


def test_schedules_keep_every_lag_below_one():
    for parts in ([1, 1, 1], [5, 3, 2], [97, 2, 1], [33, 33, 33, 1], [1]):
        total, seen = sum(parts), Counter()
        for t, s in enumerate(mixing.slots(parts), 1):
            seen[s] += 1
            assert all(abs(seen[k] * total - t * a) < total for k, a in enumerate(parts))
        assert all(seen[k] == a for k, a in enumerate(parts))


def planned(blocks, weights, most=mixing.MOST_PLACES):
    """Sources in the order of their slots, for each source's blocks and weight."""
    shares = sorted(set(weights))
    members = [[i for i in sorted(range(len(blocks)), key=lambda i: (-blocks[i], i)) if weights[i] == w] for w in shares]
    plan = mixing.Plan([Counter(blocks[i] for i in m) for m in members], shares, most)
    held = {(k, p, c): s for k, p, c, s in plan.make()}
    order = {}
    for k, m in enumerate(members):
        for rank, i in enumerate(m):
            j = np.arange(blocks[i])
            for r in plan.places(np.full(len(j), k), j, np.full(len(j), rank)).itertuples():
                slot = r.slot if r.slot >= 0 else held[k, r.phase, r.at // mixing.CHUNK][r.at % mixing.CHUNK]
                assert slot not in order and r.release <= slot < r.deadline
                order[slot] = i
    assert sorted(order) == list(range(sum(blocks)))
    return [order[t] for t in range(len(order))]


def test_mixing_keeps_to_the_asked_weights_over_many_slots(spark):
    rng = np.random.default_rng(1)
    cases = [
        ([Fraction(1)] * 21, [300] * 21), ([Fraction(1)] * 3, [7000] * 3), ([Fraction(1, 5000), Fraction("0.3"), Fraction("0.123456789012345")], [9, 9000, 7000]), ([Fraction(1, 7), Fraction(2, 3)], [4, 50]),
        ([Fraction(1, 3), Fraction("0.12345"), Fraction("0.00001"), *[Fraction(1)] * 7], [500, 300, 3, *rng.integers(100, 900, 7).tolist()]), ([Fraction(1)] * 1001, rng.integers(1, 6, 1001).tolist()), ([Fraction(1 + i % 3, 7) for i in range(60)], rng.integers(20, 60, 60).tolist()),
    ]
    for weights, blocks in cases:
        for most in (mixing.MOST_PLACES, 50):
            order = planned(blocks, weights, most)
            assert Counter(order) == dict(enumerate(blocks))
            if len(blocks) < 100:
                assert checked_lags(order, dict(enumerate(weights))) > 3
    held = mixing.Plan([Counter(rng.integers(1, 6, 1001).tolist())], [Fraction(1)])
    assert not list(held.make()) and sum(len(x) for r in held.rounds for x in r) < 30  # what the driver holds doesn't grow with sources
    df = spark.range(3000).selectExpr("id doc_id", "case when id % 10 = 0 then 'a' when id % 3 = 0 then 'b' else 'c' end source")
    for most in (1 << 20, 100):
        got = mixing.mix(df, block=1, weights={"a": 0.10007, "b": 0.30011}, most_places=most).orderBy("position").collect()
        assert checked_lags(slots_of(got), {"a": Fraction("0.10007"), "b": Fraction("0.30011"), "c": Fraction(1)}) > 900


def flat_edf(blocks, weights):
    """Every slot's source: of those with a released block the one with the earliest deadline, then of more blocks, then by name; a new phase when one has run out."""
    left, out = dict(blocks), []
    while any(left.values()):
        live = sorted((s for s in left if left[s]), key=lambda s: (-blocks[s], s))
        total, done, t = sum(weights[s] for s in live), Counter(), 0
        while all(left[s] for s in live):
            ready = [(-(-(done[s] + 1) * total // weights[s]), k, s) for k, s in enumerate(live) if done[s] * total // weights[s] <= t]
            s = min(ready)[2]
            out.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
    return out


def test_registered_mix_is_earliest_deadline_first_over_all_sources(spark, tmp_path):
    sizes = {f"src{k}": 40 + 97 * k % 400 for k in range(13)} | {"none": 100}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op2_pfair_mix(spark, str(tmp_path)).orderBy("position").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows) and len({r["position"] for r in got}) == len(rows)
    weights = {s: 1 + int(s[3:]) % 5 if s != "none" else 1 for s in sizes}
    assert len(set(weights.values())) == 5
    order = flat_edf({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, weights)
    assert slots_of(got) == order
    assert checked_lags(order, {s: Fraction(w) for s, w in weights.items()}) > 20


def test_following_through_is_earliest_deadline_first_over_all_sources():
    rng = np.random.default_rng(2)
    for n, most, weights in ((1, 5, [1]), (40, 2, [1, 2, 3, 4, 5]), (90, 30, [1, 2, 3, 4, 5]), (60, 9, [Fraction(1, 7), Fraction("0.3"), Fraction(40)]), (70, 20, [1]), (30, 40, range(1, 31))):
        blocks = sorted(rng.integers(1, most + 1, n).tolist(), reverse=True)
        kinds = rng.integers(0, len(weights), n).tolist()
        rows = list(mixing.followed(blocks, kinds, mixing.exact([Fraction(w) for w in weights])))
        assert [r[0] for r in rows] == flat_edf(dict(enumerate(blocks)), {i: Fraction(weights[k]) for i, k in enumerate(kinds)})
        assert [r[2] for r in rows] == list(range(sum(blocks))) and all(r[3] <= r[2] < r[4] for r in rows)
        assert sorted(r[:2] for r in rows) == [(i, j) for i, n in enumerate(blocks) for j in range(n)]


def test_registered_mix_has_one_rule_whatever_the_number_of_sources(spark, tmp_path):
    sizes = {f"src{k}": 1 + 97 * k % 90 for k in range(262)} | {"none": 900}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op2_pfair_mix(spark, str(tmp_path)).orderBy("position").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows) and len({r["position"] for r in got}) == len(rows)
    weights = {s: 1 + int(s[3:]) % 5 if s != "none" else 1 for s in sizes}
    assert slots_of(got) == flat_edf({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, weights)


def test_neither_rule_depends_on_how_it_is_worked_out(spark, monkeypatch):
    df = spark.range(900).selectExpr("id doc_id", "case when id % 10 = 0 then null when id % 3 = 0 then 'b' when id % 7 = 1 then 'd' else 'c' end source").repartition(3, "doc_id")
    for own in (False, True):
        made = []
        for few in (2, 256):
            monkeypatch.setattr(mixing, "FEW_SOURCES", few)
            made.append(Counter(map(tuple, mixing.mix(df, weights={"b": 0.3, None: 2}, block=4, own_windows=own).collect())))
        assert made[0] == made[1] and sum(made[0].values()) == 900


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    spark.range(200_000).selectExpr("if(id < 199000, 7L, id) doc_id", "'a' source").repartition(8).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = mixing.mix(df)
    assert got.agg(F.countDistinct("position"), F.max("rank")).first()[:] == (200_000, 199_999)
    place = F.xxhash64(F.lit(0), F.col("doc_id").cast("string"), *mixing.origin(df))
    assert df.groupBy(place).count().agg(F.max("count")).first()[0] < 40_000
    assert mixing.origin(df.join(df.select("doc_id").distinct(), "doc_id")) == []


def test_mixing_of_many_sources(spark):
    df = spark.range(5000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 1500)) source")
    got = mixing.mix(df, block=4).orderBy("position").collect()
    assert len(got) == 5000 and len(set(slots_of(got)[:1001])) == 1001
