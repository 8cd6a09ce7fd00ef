"""Document rates that mix sources to target weights, by soft membership.

A classifier trained on rows with a known source (a sample of at most about
``max_train``, split evenly among the sources) gives every document a posterior
over the sources. The posterior of its text is a document's membership; its own
``source`` is used for training only, never for its prediction.

The rates r >= 0 (expected copies of a document) minimise the sum over sources k of
(T_k - b_k)^2 / S_k, where T_k = sum r * tokens * membership, S_k is T_k at
r = 1 and b_k the target. Projected gradient steps with momentum start at r = 1:

    y = r + j / (j + 3) * (r - r of the step before),  j steps since momentum was dropped
    r <- max(0, y - sum_k membership_k * (T_k(y) - b_k) / S_k)

In the metric of tokens this is the gradient at step 1, which is safe: the
Hessian divided by S has rows that sum to 1. A document's rate follows from the
residuals of all steps so far, so no rates are stored between steps: a step sends K
numbers to the tasks and gets K sums and the objective's movement back, combined before the shuffle.

Totals can only be moved as far as the texts tell sources apart; where they say
little, the fit ends short of its targets, and says so (``converged``, ``miss``).

There is no limit to the number of sources K; a row's membership and a step hold K numbers, the classifier
LATENT * K.

Nulls: a null or wordless text has 0 tokens and changes no total; it still gets
a rate. Repeated rows count as documents each; extra columns are ignored; an
empty table gives an empty result. Without any known source every document
belongs to one source '' and the rates are 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sonarmill.llm.language import WIDTH, gram_counts
from sonarmill.llm.textnum import slabs, word_spans
from sonarmill.session import cut

MAX_TRAIN = 4000
SENT_SOURCES = 100_000  # rows of a source and a number that may be broadcast
TEMPER = 0.5  # default targets: token shares to this power
MAX_STEPS = 60
TOLERANCE = 1e-4  # share of all tokens
LATENT = 96


ADDED = ("n_tokens", "domain", "membership", "rate", "expected_tokens")
ADDED_DDL = "n_tokens long, domain string, membership double, rate double, expected_tokens double"


@dataclass
class Model:
    sources: list[str]
    project: np.ndarray
    coef: np.ndarray
    bias: np.ndarray


def _latent(counts: np.ndarray, project: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v @ project


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def projection() -> np.ndarray:
    """The fixed random directions that n-gram vectors are projected on."""
    rng = np.random.Generator(np.random.PCG64(29))
    return (rng.normal(0, 1, (WIDTH, LATENT)) / LATENT**0.5).astype(np.float32)


def fit(labels: list[str], counts: np.ndarray, sources: list[str], shares: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> Model:
    """Multinomial logistic regression on projected n-gram vectors; ``shares`` are the sources' shares of all rows."""
    project = projection()
    return fit_projected(labels, _latent(counts, project), project, sources, shares, steps, ridge)


def fit_projected(labels: list[str], x: np.ndarray, project: np.ndarray, sources: list[str], shares: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> Model:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    place = {s: k for k, s in enumerate(sources)}
    y = np.array([place[s] for s in labels])
    gold = np.eye(len(sources))[y]
    coef, bias = np.zeros((LATENT, len(sources))), np.zeros(len(sources))
    fast, rate = coef, 1.0 / (0.5 * (np.linalg.norm(x, 2) ** 2 / len(x)) + ridge)
    for k in range(steps):
        p = softmax(x @ fast + bias)
        new = fast - rate * (x.T @ (p - gold) / len(x) + ridge * fast)
        bias = bias - rate * (p - gold).mean(axis=0)
        fast, coef = new + k / (k + 3) * (new - coef), new
    coef = coef / spread[:, None]
    # The sample is even among sources; the prior goes back to the sources' shares.
    even = np.bincount(y, minlength=len(sources)) / len(y)
    return Model(sources, project, coef, bias - mean @ coef + np.log(np.maximum(shares, 1e-12)) - np.log(np.maximum(even, 1e-6)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, projected n-gram vector): LATENT numbers a row go to the driver, not WIDTH."""
    project = projection()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            x = _latent(np.stack([np.minimum(c, 65535).astype(np.uint16) for _, c, _ in gram_counts(part.column(0))]), project)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["source", "x"])


def _share_table(like: DataFrame, shares: dict[str, int]) -> DataFrame:
    """(source, share) as a table of one row a source; it is sent to the tasks unless the sources are very many."""
    table = like.sparkSession.createDataFrame(list(shares.items()), "source string, share long")
    return F.broadcast(table) if len(shares) <= SENT_SOURCES else table


def learn(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).where("source is not null")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, max_train // len(sizes))
    shares_of = _share_table(docs, {source: int(1_000_000 * min(1.0, each / n)) + 1 for source, n in sizes.items()})
    chosen = rows.join(shares_of, "source").where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) < F.col("share"))).limit(2 * max_train + len(sizes))
    got = chosen.select("text", "source").mapInArrow(_featured, "source string, x binary").toPandas()
    sources = sorted(sizes)
    shares = np.array([sizes[s] for s in sources], float) / sum(sizes.values())
    if not len(got):
        return Model(sources, np.zeros((WIDTH, LATENT), np.float32), np.zeros((LATENT, len(sources))), np.log(shares))
    order = np.lexsort((got["x"].to_numpy(), got["source"].to_numpy()))
    return fit_projected([got["source"][i] for i in order], np.stack([np.frombuffer(got["x"][i], np.float32) for i in order]), projection(), sources, shares)


def _memberships(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                tokens = np.concatenate([np.diff(word_spans(data, off)[2]) for _, data, off in slabs(part.column(1))])
                counts = np.stack([c for _, c, _ in gram_counts(part.column(1))])
                p = softmax(_latent(counts, model.project) @ model.coef + model.bias)
                flat = pa.array(p.astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), lists], names=["kept", "n_tokens", "p"])

    return run


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(np.float64)


def rates_of(p: np.ndarray, steps: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given steps, and the point at which the next gradient is due.

    A step is the vector (T - b) / S at the point before it, and how many steps since momentum was dropped.
    """
    r = y = np.ones(len(p))
    for v, j in steps:
        before, r = r, np.maximum(0.0, y - p @ v)
        y = r + j / (j + 3) * (r - before)
    return r, y


def _totals(k: int, steps: list[tuple[np.ndarray, int]]):
    """Sums over documents: of r and of y by source, and of tokens times the last movement of r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k + 1)
        for batch in batches:
            if batch.num_rows:
                p, tokens = _matrix(batch.column(1), k), batch.column(0).to_numpy()
                r, y = rates_of(p, steps)
                total[:k] += (r * tokens) @ p
                total[k : 2 * k] += (y * tokens) @ p
                total[2 * k] += np.abs(r - (rates_of(p, steps[:-1])[0] if steps else r)) @ tokens
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k + 1), pa.int32()), pa.array(total)], names=["k", "total"])

    return run


def totals(members: DataFrame, k: int, steps: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    rows = members.select("n_tokens", "p").mapInArrow(_totals(k, steps), "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(2 * k + 1)
    for r in rows:
        out[r["k"]] = r["total"]
    return out[:k], out[k : 2 * k], float(out[2 * k])


def _rated(steps: list[tuple[np.ndarray, int]], k: int, sources: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(2), k)
            r = rates_of(p, steps)[0]
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([sources[j] for j in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(r), pa.array(r * batch.column(1).to_numpy())],
                names=["kept", *ADDED],
            )

    return run


def mix(docs: DataFrame, targets: dict[str, float] | None = None, temper: float = TEMPER, max_train: int = MAX_TRAIN, max_steps: int = MAX_STEPS, keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """n_tokens, domain, membership, rate, expected_tokens of every row behind its ``keep`` columns (doc_id), and the fit.

    ``targets`` are weights by source (missing: 0); by default each source's
    token share to the power ``temper``. Expected totals add up to the tokens there are.
    The fit tells sources, targets, totals, steps, ``miss`` (share of tokens in the wrong source),
    ``moved`` (share of tokens by which the last step moved rates) and ``converged`` (either is within TOLERANCE).
    A kept column named like an added one gives way to it.
    """
    kept = [c for c in (keep or ["doc_id"]) if c not in ADDED]
    own = F.struct(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in kept]).alias("kept")
    base = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    model = learn(base, max_train)
    if model is None:
        model = Model([""], np.zeros((WIDTH, LATENT), np.float32), np.zeros((LATENT, 1)), np.zeros(1))
    rows = base.select("kept", "text")
    schema = StructType([rows.schema["kept"], *StructType.fromDDL("n_tokens long, p array<float>").fields])
    members = cut(rows.mapInArrow(_memberships(model), schema), "members")
    rated, fit = _mixed(members, model.sources, targets, temper, max_steps)
    return rated.select("kept.*", *ADDED), fit


def _mixed(members: DataFrame, sources: list[str], targets: dict[str, float] | None, temper: float, max_steps: int) -> tuple[DataFrame, dict]:
    k = len(sources)
    start, at_y, moved = totals(members, k, [])
    weight = np.array([targets.get(s, 0.0) for s in sources]) if targets else start**temper
    all_tokens = max(start.sum(), 1e-300)
    goal = start.sum() * weight / max(weight.sum(), 1e-300)
    floor = np.maximum(start, 1e-300)

    def loss(t: np.ndarray) -> float:
        return float(((t - goal) ** 2 / floor).sum())

    steps: list[tuple[np.ndarray, int]] = []
    now, moved, since = start, np.inf, 0
    while len(steps) < max_steps and np.abs(now - goal).sum() > TOLERANCE * all_tokens and moved > TOLERANCE * all_tokens:
        since += 1
        steps.append(((at_y - goal) / floor, since))
        before = now
        now, at_y, moved = totals(members, k, steps)
        if loss(now) > loss(before):  # momentum went too far: the next step starts from r itself
            since = 0
            steps[-1] = (steps[-1][0], 0)
            at_y = now
    miss = float(np.abs(now - goal).sum() / 2 / all_tokens)
    schema = StructType([members.schema["kept"], *StructType.fromDDL(ADDED_DDL).fields])
    rated = members.mapInArrow(_rated(steps, k, sources), schema)
    moved = 0.0 if not steps else moved / all_tokens
    return rated, {"sources": sources, "targets": goal, "totals": now, "steps": len(steps), "miss": miss, "moved": moved, "converged": 2 * miss <= TOLERANCE or moved <= TOLERANCE}


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
