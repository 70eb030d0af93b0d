import random

import pytest

import corpus_pipeline
from arcweave.llm import queries


def words(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "house", "river", "stone", "walk", "green"]) + draw.choice("abcdefghij") * draw.randint(0, 3) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, junk, a near copy, an exact copy and a shared passage."""
    draw = random.Random(3)
    texts = ["\n".join(words(draw, 30) for _ in range(draw.randint(4, 8))) for _ in range(60)]
    texts += ["### ".join(f"x{k}{j}" for j in range(80)) for k in range(6)]
    texts += [texts[0].replace("\n", " "), texts[1], "\n".join(texts[2].split("\n")[:3]) + "\n" + words(draw, 60)]
    near = texts[3].replace("\n", " ").split(" ")
    near[len(near) // 2] = "changed"
    texts += [" ".join(near)]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), texts


def test_stages(spark, corpus):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        after[name] = docs = corpus_pipeline.materialize(docs, name)
        if name != "best_fit_packing":
            assert docs.columns == names
    ids = {name: sorted(r[0] for r in df.select("doc_id").collect()) for name, df in after.items()}
    assert ids["quality_rules"] == [*range(60), 66, 67, 68, 69]
    assert ids["line_dedup"] == [*range(60), 66, 68, 69]  # 67 is an exact copy, all of whose lines are repeats
    assert ids["simhash_near_dedup"] == [*range(60), 68]  # 66 and 69 are near copies of 0 and 3
    kept = {r["doc_id"]: r for r in after["line_dedup"].collect()}
    assert kept[68]["text"] == texts[68].split("\n")[-1] and kept[68]["n_chars"] == len(kept[68]["text"])
    taken = ids["source_mixing"]
    assert set(taken) <= set(ids["simhash_near_dedup"]) and max(map(taken.count, taken)) <= 2
    size = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert size(after["source_mixing"]) == pytest.approx(1.5 * size(after["simhash_near_dedup"]), rel=0.05)
    packed = after["best_fit_packing"].collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(set(taken)) and sum(r["start"] == 0 for r in packed) == len(taken)


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 60
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(queries.queries()) <= set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
