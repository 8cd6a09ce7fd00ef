import numpy as np
from pyspark.sql import functions as F

from sonarmill.llm import mixing


def told_apart(spark, n=300, seed=6):
    """Documents whose words tell their source."""
    rng = np.random.default_rng(seed)
    alphabets = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    rows = []
    for k in range(n):
        s = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        text = " ".join("".join(rng.choice(list(alphabets[s]), 5)) for _ in range(int(rng.integers(20, 80))))
        rows.append((k, text, f"s{s}" if k % 5 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_totals_meet_the_targets(spark):
    docs = told_apart(spark)
    targets = {f"s{k}": 1.0 + k for k in range(3)}
    rated, fit = mixing.mix(docs, targets)
    rows = rated.collect()
    assert len(rows) == docs.count() and min(r["rate"] for r in rows) >= 0
    assert np.abs(fit["totals"] - fit["targets"]).sum() < 0.01 * fit["targets"].sum() and fit["converged"]
    shares = np.array([targets[s] for s in fit["sources"]])
    assert np.allclose(fit["targets"] / fit["targets"].sum(), shares / shares.sum())


def test_a_rows_own_source_is_no_input_of_its_membership(spark):
    docs = told_apart(spark)
    model = mixing.learn(docs)
    other = docs.selectExpr("doc_id", "text", "'s0' as source")
    both = [[list(r) for r in d.select("doc_id", "text").mapInArrow(mixing._memberships(model), "kept long, n_tokens long, p array<float>").orderBy("kept").collect()] for d in (docs, other)]
    assert both[0] == both[1]
    rated = {r["doc_id"]: r["domain"] for r in mixing.mix(docs)[0].collect()}
    known = {r["doc_id"]: r["source"] for r in docs.collect() if r["source"]}
    assert np.mean([rated[k] == s for k, s in known.items()]) > 0.95


def test_distributed_fit_equals_brute_force(spark):
    """Rates of the job against plain projected gradient on the whole matrix, run to the end."""
    rng = np.random.default_rng(12)
    p = rng.dirichlet(np.ones(4) * 0.5, 150)
    p = p.astype(np.float32).astype(np.float64)
    tokens = rng.integers(0, 400, 150)
    members = spark.createDataFrame([(k, int(t), [float(v) for v in q]) for k, (t, q) in enumerate(zip(tokens, p, strict=True))], "kept long, n_tokens long, p array<float>").repartition(3)
    targets = {"a": 1.0, "b": 6.0, "c": 2.0, "d": 0.5}
    rated, fit = mixing._mixed(members, list("abcd"), targets, 0.5, 60)
    start = tokens @ p
    goal = start.sum() * np.array(list(targets.values())) / sum(targets.values())
    r = np.ones(150)
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (((r * tokens) @ p - goal) / start))
    best = ((((r * tokens) @ p - goal) ** 2) / start).sum()
    got = np.array([x["rate"] for x in rated.orderBy("kept").collect()])
    loss = ((((got * tokens) @ p - goal) ** 2) / start).sum()
    assert got.min() >= 0 and loss - best < 1e-4 * start.sum()
    assert np.allclose((got * tokens) @ p, fit["totals"], rtol=1e-4)


def test_a_fit_that_cannot_reach_its_targets_says_so(spark):
    members = spark.createDataFrame([(k, 100, [0.5, 0.5]) for k in range(20)], "kept long, n_tokens long, p array<float>")
    _, fit = mixing._mixed(members, ["a", "b"], {"a": 1.0, "b": 0.0}, 0.5, 60)
    assert fit["miss"] > 0.4 and fit["steps"] < 60
    _, short = mixing._mixed(members.selectExpr("kept", "n_tokens", "array(float(kept / 20), float(1 - kept / 20)) as p"), ["a", "b"], {"a": 1.0, "b": 3.0}, 0.5, 1)
    assert not short["converged"]


def test_steps_reach_the_least_squares_solution():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(3) * 0.4, 200)
    tokens = rng.integers(1, 500, 200).astype(float)
    start = tokens @ p
    goal = start.sum() * np.array([0.7, 0.25, 0.05])
    steps, now, r = [], start, np.ones(200)
    for k in range(20_000):
        steps.append((now - goal) / start)
        r = np.maximum(0, r - p @ steps[-1])
        if k < 30:
            assert np.allclose(r, mixing.rates_of(p, [(v, 0) for v in steps])[0])
        now = (r * tokens) @ p
    pull = p @ ((now - goal) / start)  # gradient over tokens
    assert r.min() >= 0
    assert (np.abs(pull[r > 1e-6]) < 1e-4).all() and (pull[r <= 1e-6] > -1e-4).all()


def test_posteriors_follow_the_text():
    rng = np.random.default_rng(3)
    shape = rng.integers(0, 30, (2, mixing.WIDTH))
    counts = np.array([rng.poisson(shape[k % 2]) for k in range(120)])
    model = mixing.fit([f"s{k % 2}" for k in range(120)], counts, ["s0", "s1"], np.array([0.5, 0.5]))
    p = mixing.softmax(mixing._latent(counts, model.project) @ model.coef + model.bias)
    assert (p.argmax(axis=1) == np.arange(120) % 2).mean() > 0.97


def test_odd_rows(odd, nothing):
    rated, fit = mixing.mix(odd)
    rows = rated.collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["rate"]) and r["rate"] >= 0 for r in rows)
    assert fit["sources"] == ["a", "b", "c"]
    assert {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: 0, 4: 7}
    assert mixing.mix(nothing)[0].count() == 0
    whole = mixing.mix(odd.withColumn("rate", F.lit("x")), keep=[*odd.columns, "rate"])[0]
    assert whole.columns == [*odd.columns, *mixing.ADDED] and whole.count() == odd.count()
    assert whole.where("text is null and doc_id = 1 and rate >= 0").count() == 1
    alone = mixing.mix(odd.drop("source").selectExpr("*", "cast(null as string) as source"))[0].collect()
    assert all(abs(r["rate"] - 1) < 1e-9 for r in alone)
