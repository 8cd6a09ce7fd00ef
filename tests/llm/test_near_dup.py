import random
import re

import numpy as np
import pytest

from sonarmill.llm import components, near_dup
from sonarmill.session import cut


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    rng = random.Random(1)
    texts = []
    for size, copies, edits in ((150, 60, 5), (40, 25, 2), (12, 15, 1), (300, 30, 12)):
        texts += family(rng, [f"w{rng.randrange(2000)}" for _ in range(size)], copies, edits)
    texts += [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randint(1, 80))) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, percent).collect()}
    assert got == brute(rows, percent)


def test_chains_join_through_their_middle(spark):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base[:k] + [f"x{j}" for j in range(k, 100)][:0] + base[k:] + [f"t{j}" for j in range(2 * k)]) for k in range(8)]
    rows = list(enumerate(texts, 5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 85)


def test_odd_rows(odd, nothing):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[3]["kept"]
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[4]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[7]["n_shingles"] == 1 and by[7]["kept"]
    assert near_dup.near_duplicates(nothing).count() == 0


def test_registers_keep_order_and_size():
    v = np.array([1, 2, 3, 2**63, 2**64 - 1, 2**40 + 12345], np.uint64)
    lead = near_dup.registers_of(v) >> near_dup.MANTISSA
    assert lead.tolist() == [64 - int(x).bit_length() for x in v]


def equal_registers(x, y):
    lanes = [[(v >> (near_dup.LANE * k)) & ((1 << near_dup.LANE) - 1) for v in d for k in range(near_dup.LANES)] for d in (x, y)]
    return sum(a == b for a, b in zip(*lanes, strict=True))


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    x, y = pool[:2000], pool[400:2400]
    d = [near_dup.digest_of(near_dup.sketch(s, near_dup.DIGEST)) for s in (x, y)]
    share, c = equal_registers(*d) / near_dup.DIGEST, near_dup.CHANCE
    assert abs((share - c) / (1 - c) - 1600 / 2400) < 0.12


def test_registers_of_unlike_sets_agree_as_often_as_the_correction_says():
    rng = np.random.default_rng(4)
    agree = tried = 0
    for _ in range(60):
        n, m = 300, 900
        d = [near_dup.digest_of(near_dup.sketch(rng.integers(1, 2**63, k, dtype=np.uint64), near_dup.DIGEST)) for k in (n, m)]
        agree, tried = agree + equal_registers(*d), tried + near_dup.DIGEST
    expected = near_dup.CHANCE * 4 * n * m / (n + m) ** 2
    assert abs(agree / tried - expected) < 5 * (expected / tried) ** 0.5


def glance(d):
    k = near_dup.GLANCE
    return (equal_registers(*(x[: k // near_dup.LANES] for x in d)) / k - near_dup.CHANCE) / (1 - near_dup.CHANCE)


def test_condition_in_sql_is_the_estimate(spark):
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 2**63, 4000, dtype=np.uint64)
    rows, want = [], []
    for shift in range(0, 600, 40):
        x, y = pool[:1000], pool[shift : 1000 + shift]
        d = [near_dup.digest_of(near_dup.sketch(s, near_dup.DIGEST)) for s in (x, y)]
        c = near_dup.CHANCE
        least = 0.8 - near_dup.SURE * (0.8 * 0.2 / near_dup.DIGEST) ** 0.5
        want.append((equal_registers(*d) / near_dup.DIGEST - c) / (1 - c) >= least and glance(d) >= 0.8 - near_dup.SURE * (0.8 * 0.2 / near_dup.GLANCE) ** 0.5)
        rows.append((shift, (1000, d[0]), (1000, d[1])))
    kind = "struct<n: long, d: array<long>>"
    got = spark.createDataFrame(rows, f"k int, x {kind}, y {kind}").selectExpr("k", near_dup.may_reach(80) + " as ok").orderBy("k").collect()
    assert [r["ok"] for r in got] == want and any(want) and not all(want)


def test_texts_that_share_a_doc_id_are_one_document(spark):
    """Rows (1, A), (1, B), (2, near A), (3, near B): all of one component."""
    a, b = ([f"{x}{k}" for k in range(120)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1])), (9, "other words")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_large_buckets_are_dealt_to_tasks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SPLIT", 3)
    rng = random.Random(8)
    common = [f"c{k}" for k in range(90)]
    texts = [" ".join(common + [f"f{f}x{k}" for k in range(14)] + [f"r{rng.randrange(10**6)}"]) for f in range(12) for _ in range(3)]
    rows = [(2 * k - 20, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 85)


def test_condition_in_sql_stays_short():
    """The driver plans and compiles it again and again: terms for the glance, one for the digest."""
    assert near_dup.may_reach(80).count("bit_count") == near_dup.GLANCE // near_dup.LANES + 1


def test_star_steps_send_nothing_through_the_driver(spark):
    rng = random.Random(3)
    links = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1000, 1040)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(220)] + [(7, None), (5, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert {(r["id"], r["component"]) for r in components.components(frame).collect()} == {(i, find(i)) for i in list(root)}

    edges = cut(frame.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges")
    for large in (True, False):
        step = components._star(edges, large)
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
