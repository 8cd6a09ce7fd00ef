import zlib

import numpy as np
import pyarrow as pa

from sonarmill.llm import language


def test_held_out_accuracy(spark, medium):
    got = language.op2_language(spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(odd, nothing):
    model = language.learn(odd)
    got = language.classify(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (1, 2, 3, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    assert language.learn(nothing) is None
    assert language.classify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in language.classify(odd, None).collect()} == {"und"}


def test_letters_of_any_script_count():
    texts = ["12 !", "ж", "中", "½ ²", "", None, "a"]
    assert [letter for _, _, letter in language.gram_counts(pa.array(texts, pa.string()))] == [False, True, True, False, False, False, True]


def test_capitals_fold():
    a, b = (c for _, c, _ in language.gram_counts(pa.array(["ÉCOLE Ñ", "école ñ"], pa.string())))
    assert (a == b).all()


def test_rejection_by_distance():
    rng = np.random.default_rng(0)
    shape = {"x": rng.integers(0, 60, language.WIDTH), "y": rng.integers(0, 60, language.WIDTH)}
    rows = [(k, rng.poisson(v)) for k, v in shape.items() for _ in range(60)]
    model = language.fit([k for k, _ in rows], np.array([c for _, c in rows]), k=2)
    far = np.zeros((1, language.WIDTH), int)
    far[0, :5] = 100
    cos = language.vectors(far, model.idf) @ model.centroids.T
    assert (cos.max(axis=1) < model.radius[cos.argmax(axis=1)]).all()
    near = language.vectors(np.array([c for _, c in rows]), model.idf) @ model.centroids.T
    assert (near.max(axis=1) >= model.radius[near.argmax(axis=1)]).mean() > 0.95


def test_one_language_may_have_several_centroids():
    rng = np.random.default_rng(1)
    a, b = np.zeros(50), np.zeros(50)
    a[:10], b[20:30] = 1, 1
    v = np.array([x + rng.normal(0, 0.01, 50) for x in (a, b) for _ in range(20)], np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert len(np.unique((v @ language.clusters(v, 2).T).argmax(axis=1).reshape(2, 20), axis=1).T) == 1
