import random

import pytest

from sonarmill.llm import toxicity as tox


def distance(a, b):
    """Edits with swaps of neighbours (each place touched once)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_distances():
    rng = random.Random(2)
    terms = ["abcab", "bad", "caabbc", "abcabcabc", "cbacbacbab"]
    machine = tox.Automaton(terms, [])
    for _ in range(3000):
        token = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        if rng.random() < 0.6:
            token = list(rng.choice(terms))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(token) + 1)
                token[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
            token = "".join(token)
        near = [(distance(token, t), t) for t in terms if distance(token, t) <= tox.edits_for(len(t))]
        got = machine.match(token)
        assert (got and got[1]) == (min(near)[0] if near else None), token


def test_beginnings_match_exactly():
    machine = tox.Automaton(["idiot"], ["lowei"])
    assert machine.match("loweisch") == ("lowei*", 0)
    assert machine.match("loveisch") is None
    assert machine.match("idoit") == ("idiot", 1)
    assert machine.match("i") is None and machine.match("") is None


def _corpus(rng, n):
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randrange(400)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["worthless", "moron", "pathetic"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = _corpus(random.Random(4), 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    return docs, dict(labels), tox.learn(docs, marks)


def test_learns_terms_and_scores_held_out(trained):
    docs, labels, model = trained
    assert set(model.words) >= {"worthless", "moron", "pathetic"}
    got = tox.score(docs, model).collect()
    held = [(r["score"] >= tox.THRESHOLD, labels[r["doc_id"]]) for r in got if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.97


def test_misspellings_count_and_quotation_does_not(spark, trained):
    _, _, model = trained
    calm = "the weather stayed calm over the hills and the river ran low all summer "
    rows = [
        (1, calm * 3 + "you are a moron and a worthless pathetic moron " + calm),
        (2, calm * 3 + "you are a mroon and a wrothless pathetik person " + calm),
        (3, calm * 4),
        (4, calm * 3 + "he wrote that the word moron is rude " + calm),
        (5, ""),
        (6, None),
    ]
    got = {r["doc_id"]: r for r in tox.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["score"] > 0.7 and got[2]["score"] > 0.7
    assert got[3]["score"] < 0.3 and got[4]["score"] < got[1]["score"] and got[4]["hits"][0]["quoted"]
    assert got[5]["score"] == got[6]["score"] < 0.3


def test_odd_rows_and_no_labels(spark, odd, nothing, trained):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.learn(odd, labels)
    assert all(r["score"] < 1e-9 for r in tox.score(odd, model).collect())
    assert tox.score(odd, trained[2]).count() == odd.count()
    assert tox.score(nothing, trained[2]).count() == 0


def test_a_full_cache_changes_no_hit():
    class Small(tox.Scanner):
        KNOWN = 5

    model = tox.Model(words=["worthless", "moron"], prefixes=["pathe"])
    rows, _ = _corpus(random.Random(6), 80)
    small, whole = Small(model), tox.Scanner(model)
    got = [small.scan(t) for _, t in rows]
    assert got == [whole.scan(t) for _, t in rows] and any(h for _, h in got)
