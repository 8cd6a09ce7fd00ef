import collections
import random
import re

import pytest

from sonarmill.llm import quality


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = collections.Counter(windows)
    hit = {j for k, x in enumerate(windows) if seen[x] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark):
    rng = random.Random(6)
    pool = ["a", "b", "The", "é x", "c|", "#", "d"]
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(200, "same line\nsame line\n \n \nsame line"), (201, None), (202, "")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in got} == {k: counts(t) for k, t in rows}
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_main_path_is_native(spark, small):
    plan = quality.judge(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_em_finds_the_good_rules():
    rng = random.Random(1)
    accuracy, patterns = (0.95, 0.9, 0.85, 0.5), collections.Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.8 else -1
        patterns[tuple(0 if rng.random() < 0.2 else y if rng.random() < a else -y for a in accuracy)] += 1
    share, rates = quality.fit(sorted(patterns.items()))
    assert abs(share - 0.8) < 0.03
    for a, (good, bad) in zip(accuracy, rates, strict=True):
        assert abs(good - a) < 0.06 and abs(bad - a) < 0.12
    assert quality.posterior((1, 1, 1, 0), share, rates) > 0.95 > 0.05 > quality.posterior((-1, -1, -1, 0), share, rates)
    assert quality.fit([]) == (0.85, [])


def test_column_posterior_equals_python(spark, small):
    judged = quality.judge(spark.read.parquet(f"{small}/documents.parquet")).collect()
    names = [f"vote_{k}" for k in quality.rules()]
    seen = collections.Counter(tuple(r[n] for n in names) for r in judged)
    share, rates = quality.fit(sorted(seen.items()))
    for r in judged:
        assert r["posterior"] == pytest.approx(quality.posterior([r[n] for n in names], share, rates), abs=1e-9)


def test_quality_labels_are_mostly_met(spark, medium):
    judged = quality.op7_quality(spark, medium).select("doc_id", "kept", "base_failed")
    rows = judged.join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [not r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.6


def test_odd_rows(odd, nothing):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count()
    assert all(r["n_words"] == 0 and r["base_failed"] for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.judge(nothing).count() == 0
