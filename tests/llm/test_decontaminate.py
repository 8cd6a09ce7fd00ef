import collections
import random
import re

import numpy as np

from sonarmill.llm import decontaminate as dec


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def brute(docs, items, similarity=0.8):
    own = {i: (len(words(t)), collections.Counter(shingles(words(t)))) for i, t in items}
    spread = collections.Counter(s for _, c in own.values() for s in c)
    out = {}
    for d, t in docs:
        w = words(t)
        for i, (n, c) in own.items():
            if not c or not w:
                continue
            total = sum(k / spread[s] for s, k in c.items())
            best = max(sum(min(k, win[s]) / spread[s] for s, k in c.items()) / total for at in range(max(1, len(w) - n + 1)) for win in [collections.Counter(shingles(w[at : at + n]))])
            if best >= similarity:
                out[d, i] = round(best, 9)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"B{rng.randrange(900)}" for _ in range(rng.randint(12, 60)))) for k in range(25)]
    items += [(90, "one two three"), (91, None), (92, ""), (93, items[0][1])]
    docs = []
    for k in range(150):
        text = [f"d{rng.randrange(3000)}" for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.7:
            w = words(rng.choice(items[:25])[1])
            for _ in range(rng.randint(0, 3)):
                j = rng.randrange(len(w))
                w[j : j + rng.randint(0, 1)] = rng.choice([[], ["new"]])
            text[rng.randint(0, len(text)) :][:0] = []
            at = rng.randint(0, len(text))
            text = text[:at] + w + text[at:]
        docs.append((k, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "One two\nTHREE"), (503, items[3][1]), (503, items[3][1])]
    want = brute(docs, items)
    got = dec.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    assert sum(r["doc_id"] == 503 and r["item_id"] == 3 for r in got) == 2


def test_blocks_of_items_change_nothing(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, dec.find_leaks(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(dec, "ITEMS_PER_BLOCK", 7)
    assert sorted(map(tuple, dec.find_leaks(docs, items).select("doc_id", "item_id").collect())) == whole and whole


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(5)
    items = dec.Items(list(range(300)), [" ".join(f"w{x}" for x in rng.integers(0, 500, 30)) for _ in range(300)])
    for k in range(300):
        f = np.unpackbits(items.prints[k])
        f[rng.choice(128, dec.RADIUS, replace=False)] ^= 1
        found = items.within(np.packbits(f))
        far = (np.unpackbits(items.prints, axis=1) ^ f).sum(axis=1)
        assert found.tolist() == np.flatnonzero(far <= dec.RADIUS).tolist()


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one two three four five six"), (None, "nobody has this line of words"), (2, None)], "item_id long, text string")
    got = dec.find_leaks(odd, items).collect()
    assert {r["doc_id"] for r in got} == {4, 5}
    assert dec.find_leaks(nothing, items).count() == 0
    assert dec.find_leaks(odd, items.limit(0)).count() == 0


def found_and_wanted(spark, docs, items):
    got = dec.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got}, brute(docs, items)


def test_reordered_and_edited_passages_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"b{rng.randrange(900)}" for _ in range(60))) for k in range(12)]
    docs = []
    for k in range(120):
        w = words(items[k % 12][1])
        if k % 3 == 0:
            cut = rng.randint(5, 55)
            w = w[cut:] + w[:cut]
        else:
            at = rng.randint(0, 50)
            w[at : at + rng.randint(0, 4)] = ["new"] * rng.randint(0, 8)
        if k % 3 == 1:
            at = rng.randint(0, 50)
            w[at : at + 3] = []
        text = [f"d{rng.randrange(3000)}" for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(text))
        docs.append((k, " ".join(text[:at] + w + text[at:])))
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and any(d % 3 == 0 for d, _ in want)


def test_items_with_a_common_template_equal_brute_force(spark):
    rng = random.Random(9)
    some = lambda n: [f"b{rng.randrange(10**6)}" for _ in range(n)]
    template = some(36)
    own = [some(24) for _ in range(40)]
    items = [(k, " ".join(template + o)) for k, o in enumerate(own)]
    docs = [(k, " ".join(some(40) + o + some(40))) for k, o in enumerate(own)] + [(99, " ".join(template))]
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and {(k, k) for k in range(40)} <= set(want)


def test_short_items_are_found_inside_longer_texts(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "One two three four"), (4, "one two three four five six"), (5, "two three")]
    docs = [(1, "x y alpha z a b c"), (2, "q beta gamma"), (3, "a b c one two three four d e"), (4, "beta x gamma alphas and more"), (5, "one two three four five six"), (6, "alpha"), (7, "a two three one two three b")]
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and (3, 3) in want and (1, 1) in want


def test_filler_of_one_repeated_word_loses_nothing(spark):
    """Partial items with repeated, distinct or natural filler, 0.8 to 1 of the weight: recall against brute force."""
    rng = random.Random(21)
    items = [(k, " ".join(f"b{rng.randrange(10**5)}" for _ in range(rng.randint(30, 80)))) for k in range(50)]
    docs = []
    for k in range(150):
        w = words(items[k % 50][1])
        keep = round(len(w) * rng.uniform(0.82, 0.97))
        kind = k // 50
        filler = [["same"] * 60, [f"d{rng.randrange(10**6)}" for _ in range(60)], [rng.choice(["the", "of", "and"]) for _ in range(60)]][kind]
        docs.append((k, " ".join(filler[:30] + w[:keep] + filler)))
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and len(want) > 100


def test_a_block_changes_no_similarity(spark, monkeypatch):
    rng = random.Random(22)
    common = [f"t{k}" for k in range(24)]
    items = [(k, " ".join(common + [f"o{k}x{j}" for j in range(16)])) for k in range(6)]
    docs = [(at, " ".join(words(items[0][1])[:at] + ["z"] * 20)) for at in range(25, 41)]
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and got
    monkeypatch.setattr(dec, "ITEMS_PER_BLOCK", 2)
    assert found_and_wanted(spark, docs, items)[0] == got


def test_a_very_long_item_and_leaks_beside_other_items(spark):
    rng = random.Random(23)
    items = [(1, " ".join(f"v{rng.randrange(10**6)}" for _ in range(3000)))] + [(k, " ".join(f"b{rng.randrange(10**6)}" for _ in range(40))) for k in range(2, 20)]
    docs = [(1, items[0][1]), (2, "x " + " ".join(items[0][1].split()[:2600]))]
    docs += [(k, " ".join(words(items[k][1])[:35] + words(items[k + 1][1])[:30])) for k in range(2, 18)]
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and len(want) >= 18
