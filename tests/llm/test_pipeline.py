"""The stages of the pipeline on a small corpus, each against what it should keep."""

import random

import pytest

pytest.importorskip("ecoloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ecoloom.llm import pii  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "en"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    folder = tmp_path_factory.mktemp("corpus")
    item = say(14)
    rows = []
    for i in range(300):
        text = " ".join([say(1)] * 50) if i % 6 == 0 else say(60)
        if i % 50 == 1:
            text = f"{say(20)} {item} {say(20)}"
        if i % 50 == 2:
            text += " write to jo.12@mail.example.com"
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
    for copy, of in ((301, 7), (302, 7), (303, 8)):
        rows.append([copy, rows[of][1], "en", "s1", rows[of][4]])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        if name != "mixing":
            assert docs.columns == COLUMNS
        kept[name] = (set(before), {r["doc_id"] for r in docs.collect()}, before)
    gone = {name: a - b for name, (a, b, _) in kept.items()}
    bad = {i for i in range(300) if i % 6 == 0 and i % 50 not in (1, 2)}
    assert gone["quality"] <= {i for i in range(300) if i % 6 == 0} and len(gone["quality"] & bad) >= 0.9 * len(bad)
    assert {301, 302, 303} <= gone["near_duplicates"] and gone["near_duplicates"] <= {301, 302, 303, *bad}
    assert gone["decontamination"] == {i for i in kept["decontamination"][0] if i % 50 == 1 and i < 300}
    assert not gone["personal_data"]
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{corpus}/personal_data").collect()}
    for i, r in kept["personal_data"][2].items():
        if i % 50 == 2 and i < 300:
            assert "jo.12@" not in texts[i]["text"] and len(texts[i]["text"]) == texts[i]["n_chars"] == len(r["text"])
        else:
            assert texts[i]["text"] == r["text"]
    assert pii.KINDS


def test_run_gives_the_stages_rows(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0


def test_rows_without_ids_and_with_one_id_are_decided_by_themselves(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").first()["text"]
    clean = [texts[i] for i in range(3, 120) if i % 6 and i % 50 not in (1, 2, 7, 8)]

    def rows(pairs):
        return spark.createDataFrame([(i, t, "en", f"s{len(t) % 2}", len(t)) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")

    def left(stage, pairs):
        return sorted(r["text"] for r in stage(spark, rows(pairs), corpus).collect())

    junk, odd = texts[0], [(None, texts[0]), (0, clean[0]), (None, clean[1])]
    judged = left(corpus_pipeline.keep_quality, list(texts.items()) + odd)
    assert junk not in judged and judged.count(clean[0]) == 2 and judged.count(clean[1]) == 2
    near = clean[0] + " more"
    once = left(corpus_pipeline.drop_near_duplicates, [(None, clean[0]), (None, near), (5, clean[1]), (5, clean[1]), (None, clean[2]), (None, clean[2]), (9, clean[2]), (None, clean[3])])
    assert len(once) == 4 and set(once) & {clean[0], near} and {clean[1], clean[2], clean[3]} <= set(once)
    hit = f"{clean[0]} {item} {clean[1]}"
    assert left(corpus_pipeline.drop_contaminated, [(None, hit), (None, clean[2]), (7, hit), (7, clean[3])]) == sorted([clean[2], clean[3]])

    mixed = corpus_pipeline.mix_sources(spark, rows([(None, t) for t in clean[:20]] + [(4, t) for t in clean[20:40]]), corpus).collect()
    taken = [(r["text"], r["mix_copy"]) for r in mixed]
    assert len(set(taken)) == len(taken) and all(r["mix_words"] <= len(r["text"].split()) for r in mixed)
    assert abs(sum(r["mix_words"] for r in mixed) - 1.5 * sum(len(t.split()) for t in clean[:40])) <= 2
