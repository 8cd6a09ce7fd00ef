import hashlib
import random
import re
import time

import numpy as np
import pytest

from sonarmill.llm import pii


@pytest.fixture(scope="module")
def network():
    made = [pii.window_of(t, s, 0) for t, s in pii.generated()]
    net = pii.Network()
    net.train(np.array([m[0] for m in made]), np.array([m[1] for m in made]))
    return net


def brute(text):
    """The contract's patterns, read literally."""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"], out["phone"] = [], []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


TEXTS = [
    "mail a.b@c.example.org, or x@y (no dot) é@z.fr",
    "ip 1.2.3.4.5 and 256.1.1.1 then 010.0.0.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 1 2 3",
    "call +1 (523) 555-1055 or +12 or +1234567890123456789",
    "\U0001f600 +49 30 1234567, 😀 a@b.co",
    "0" * 40 + " 1234567812345670",
    "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_contract(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_on_documents(spark, medium, network):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find(docs, network).collect():
        want = brute(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(len(want[k]) for k in pii.KINDS)
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_gradients_match_differences():
    made = [pii.window_of(t, s, 0) for t, s in pii.generated(4)]
    x, y = np.array([m[0] for m in made]), np.array([m[1] for m in made]).astype(int)
    net = pii.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    net.barred = net.barred.astype(float)
    _, grads = net.gradients(x, y)
    for k, v in net.p.items():
        at = tuple(n // 2 for n in v.shape)
        kept, ends = v[at], []
        for step in (1e-4, -1e-4):
            v[at] = kept + step
            ends.append(net.gradients(x, y)[0])
        v[at] = kept
        assert grads[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=0.05, abs=2e-3)


def test_viterbi_is_the_best_path():
    net = pii.Network(seed=4)
    x = np.arange(6)[None, :] % pii.N_CLASSES
    e, trans = net.emissions(x)[0][:, 0], net.p["trans"] + net.barred
    tags = net.decode(x)[0]
    score = lambda p: e[range(6), p].sum() + trans[p[:-1], p[1:]].sum() - 1e4 * (p[0] > 0 and p[0] % 2 == 0)
    rng = np.random.default_rng(0)
    assert all(score(tags) >= score(rng.integers(0, pii.TAGS, 6)) - 1e-4 for _ in range(5000))


def test_adds_written_variants_and_few_others(network):
    held = pii.generated(250, seed=77)
    gold = found = base = false = 0
    for (_, spans), (b, a) in zip(held, pii.Finder(network).spans([t for t, _ in held]), strict=True):
        want = {(k, *s) for k in pii.KINDS for s in spans[k]}
        own, more = ({(k, *s) for k in pii.KINDS for s in x[k]} for x in (b, a))
        gold, base, found, false = gold + len(want), base + len(want & own), found + len(want & (own | more)), false + len(more - want)
    assert found >= base + 0.9 * (gold - base) and false < 0.1 * gold


def test_windows_agree_wherever_a_span_lies(network):
    finder = pii.Finder(network)
    spans = {}
    for pad in range(0, 230, 7):
        text = "la " * pad + "write to someone (at) mail7.example.com today " + "la " * 60
        _, added = finder.spans([text])[0]
        spans[pad] = {(k, text[a:b]) for k in pii.KINDS for a, b in added[k]}
    assert sum(("email", "someone (at) mail7.example.com") in s for s in spans.values()) >= 0.9 * len(spans)
    assert all(len(s) <= 1 for s in spans.values())


def test_redaction_and_odd_rows(spark, odd, nothing, network):
    docs = spark.createDataFrame([(1, "a x@y.org b +1 (523) 555-1055.", 5), (2, None, 6), (3, "plain", 7)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.redact(docs, network).collect()}
    assert got[1]["text"] == "a [EMAIL] b [PHONE]." and got[1]["spans"] == 5
    assert got[2]["text"] is None and got[3]["text"] == "plain"
    assert pii.find(odd, network).count() == odd.count()
    assert pii.find(nothing, network).count() == 0 and pii.redact(nothing, network).count() == 0
    assert pii.redacted_text("abcdef", [("ip", 1, 4), ("phone", 3, 5)]) == "a[IP]f"


@pytest.mark.parametrize("span", ["someone (at) mail7.example.com", "kim_9 (at) " + "abc7" * 20 + ".com"])
def test_a_span_is_whole_wherever_it_lies(network, span):
    finder = pii.Finder(network)
    texts = ["la " * 30 + "x" * shift + " write to " + span + " today " + "la " * 60 for shift in range(2, 52)]
    for text, (_, added) in zip(texts, finder.spans(texts), strict=True):
        assert [text[a:b] for a, b in added["email"]] == [span]


def test_dense_texts_lose_no_span_to_seams(network):
    finder = pii.Finder(network)
    one = "la " * 10 + "joe.smith (at) company.net " + "la " * 10
    _, added = finder.spans([one * 60])[0]
    assert len(added["email"]) == 60
    assert pii.stretches("") == [] and pii.stretches("la la") == []
    assert finder.spans(["0" * 3000])[0][1] == {k: [] for k in pii.KINDS}


#: The contract's patterns as they stand, with nothing to make them linear.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}


def test_linear_patterns_match_as_the_plain_ones_do():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-_% ") if rng.random() < 0.8 else rng.choice(["a@b.c", "1.2.3.4", "..", "@@", "255.300"]) for _ in range(rng.randint(1, 24)))
        got = pii.base_spans(text)
        assert got["email"] == [m.span() for m in re.finditer(PLAIN["email"], text)], text
        assert got["ip"] == [m.span() for m in re.finditer(PLAIN["ip"], text) if all(int(p) <= 255 for p in m[0].split("."))], text


@pytest.mark.parametrize("run", ["a", "7", "a.", "1.", "+1", "@", "a@", "1 ", "("])
def test_one_long_run_takes_linear_time(run):
    text = run * (1_000_000 // len(run)) + " x@y"
    start = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - start < 1


def test_one_long_run_of_digits_is_no_work_for_the_network(network):
    start = time.perf_counter()
    assert pii.Finder(network).spans(["1234567890" * 100_000])[0][1] == {k: [] for k in pii.KINDS}
    assert time.perf_counter() - start < 2
