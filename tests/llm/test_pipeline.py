import random
import re

from test_decontaminate import brute as leaks_by_force
from test_near_dup import brute as groups_by_force

import corpus_pipeline
from sonarmill.llm import decontaminate, near_dup, pii, toxicity


def test_stages_take_effect(spark, medium, tmp_path):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    names, left = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = left
        out = stage(spark, before, medium)
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        names.append(name)
        if name != "mixing":
            assert left.columns == docs.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{medium}/labels.parquet")
            hit = toxicity.score(before, toxicity.learn(before, labels)).where(f"score >= {toxicity.THRESHOLD}").select("doc_id")
            assert left.count() == before.count() - hit.count() and hit.count() > 0
        if name == "near_dup":
            again = near_dup.near_duplicates(before, 80).where("kept").select("doc_id")
            assert left.select("doc_id").exceptAll(again).count() == 0 == again.exceptAll(left.select("doc_id")).count()
        if name == "decontamination":
            items = spark.read.parquet(f"{medium}/benchmark.parquet")
            assert decontaminate.find_leaks(left, items).count() == 0 < before.count() - left.count()
        if name == "pii":
            rows = left.collect()
            assert len(rows) == before.count()
            assert not any(s for r in rows for s in pii.base_spans(r["text"]).values() if s)
            assert any(re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"]) for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows if "[EMAIL]" in r["text"])
    assert names == ["toxicity", "near_dup", "decontamination", "pii", "mixing"]
    assert left.count() == before.count() and left.where("rate < 0").count() == 0
    assert left.select(docs.columns).exceptAll(before).count() == 0 == before.exceptAll(left.select(docs.columns)).count()


def test_run_over_odd_documents(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing that is in there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 6, 7, 8, None}


def test_run_equals_brute_force(spark, tmp_path):
    """Planted toxic words, families of near copies, leaks and patterns; what is left is worked out without the stages."""
    rng = random.Random(31)
    word = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    items = [(k, " ".join(word(30))) for k in range(6)]
    docs, labels = [], []
    for k in range(600):
        w = word(rng.randint(40, 90))
        if k % 6 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zzmoron", "zzpathetic", "zzvermin"])
        elif k % 6 == 1 and k > 20:
            w = docs[k - 6][1].split()  # a near copy of the one before it in its family
            w[rng.randrange(len(w))] = "changed"
        elif k % 6 == 2:
            w = w[:10] + items[k % 5][1].split()[: rng.choice([30, 27, 15])] + w[10:]
        elif k % 6 == 3:
            w[5:5] = ["write", "to", f"person{k}@mail.example.org", "soon"]
        docs.append((k, " ".join(w)))
        labels.append((k, 0, int(k % 6 == 0)))
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(k, t) for k, t in docs if k % 6]
    groups = groups_by_force(left, 80)
    left = [(k, t) for k, t in left if groups[k][1] == k]
    leaked = {d for d, _ in leaks_by_force(left, items)}
    left = [(k, t) for k, t in left if k not in leaked]
    assert leaked and len(left) < 450
    want = {k: re.sub(r"\S+@mail\.example\.org", "[EMAIL]", t) for k, t in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_tokens"] == len(r["text"].split()) and r["n_chars"] == len(r["text"]) for r in got)


def test_run_over_empty_tables(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
