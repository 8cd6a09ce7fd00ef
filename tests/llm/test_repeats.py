import collections
import hashlib
import random

from sonarmill.llm import repeats


def brute(rows):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + 400] for s in range(len(b) - 399))
    out = []
    for i, b in data:
        hit = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                hit[s : s + 400] = b"\1" * 400
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        out.append((i, len(b), sum(hit), len([r for r in bytes(hit).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)

    def noise(n):
        return "".join(rng.choice("abcdefgh éß \n") for _ in range(n))

    passages = [noise(n) for n in (399, 400, 401, 520, 900, 1500)]
    rows = []
    for k in range(60):
        text = noise(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages) + noise(rng.randint(0, 300))
        rows.append((k, text))
    rows += [(100, "ab" * 600), (101, "a" * 399), (102, "a" * 400), (103, "a" * 401), (104, passages[4][100:700]), (105, passages[3]), (106, passages[5][:450]), (107, passages[5][-450:]), (108, None), (109, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (10**6, 3):
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, shard_bytes=3000, hot_pieces=hot).collect()), key=str)
        assert got == brute(rows)


def test_a_hot_passage_in_many_surroundings(spark):
    """One passage of 430 bytes in 80 texts, cut at both ends in some: split cores give what brute force gives."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    hot = noise(430)
    rows = [(k, noise(rng.randint(0, 400)) + hot[rng.choice([0, 0, 0, 7, 20]) : 430 - rng.choice([0, 0, 0, 5, 40])] + noise(rng.randint(0, 400))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, hot_pieces=5).collect()), key=str)
    assert got == brute(rows) and sum(r[2] > 0 for r in got) > 40


def test_odd_rows(odd, nothing):
    got = repeats.remove_repeats(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == [x for x in sorted(_quick(rows), key=str)]
    assert repeats.remove_repeats(nothing).count() == 0


def _quick(rows):
    """The odd table's only repeats are the long texts, which are all repeats."""
    for i, t in rows:
        b = (t or "").encode()
        gone = len(b) if len(b) >= 400 else 0
        yield i, len(b), gone, int(gone > 0), hashlib.sha256(b"" if gone else b).hexdigest()


def test_every_window_has_its_anchor():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab ") for _ in range(5000)) + b"z" * 900 + bytes(rng.choice(b"xyz") for _ in range(700))
    import numpy as np

    place, h, lo, hi = repeats.anchors_of(np.frombuffer(data, np.uint8))
    covered = [s for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for s in range(a, b + 1)]
    assert covered == list(range(len(data) - 399))
    assert all(a <= p <= a + 400 - repeats.GRAM and b <= p for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True) if b == a)
    assert all(p >= b and p + repeats.GRAM <= a + 400 for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True))
