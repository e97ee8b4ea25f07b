"""Every operator and stage on odd rows, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, hostrules, html, lines, mixing, neardup, passages, quality, records, toxicity
from tests.llm.helpers import no_docs, odd_docs, odd_rows

N = len(odd_rows())


@pytest.fixture(scope="module")
def sets(spark):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 10)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far"), (2, None), (None, ""), (3, "short")], "item_id bigint, text string")
    return {"odd": odd_docs(spark).persist(), "none": no_docs(spark), "labels": labels, "items": items}


@pytest.mark.parametrize("which", ["odd", "none"])
def test_scores(spark, sets, which):
    docs = sets[which]
    model = quality.fit_ranking(docs, sets["labels"])
    found = quality.score_quality(docs, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= r["score"] <= 1 for r in found.collect()) and found.count() == docs.count()
    lexicon = toxicity.fit_lexicon(docs, sets["labels"])
    found = toxicity.score_toxicity(docs, lexicon, matched=True)
    assert all(0 <= r["score"] <= 1 for r in found.collect()) and found.count() == docs.count()


def test_without_labels(spark, sets):
    empty = sets["labels"].where("false")
    assert quality.score_quality(sets["odd"], quality.fit_ranking(sets["odd"], empty)).count() == N
    assert toxicity.score_toxicity(sets["odd"], toxicity.fit_lexicon(sets["odd"], empty)).count() == N


@pytest.mark.parametrize("which", ["odd", "none"])
def test_passages(sets, which):
    rows = passages.repeated_passages(sets[which], least_words=20).collect()
    assert bool(rows) == (which == "odd")
    assert all(r["stop"] - r["start"] >= 20 for r in rows)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_mix(sets, which):
    docs = sets[which]
    plan = mixing.mix(docs).collect()
    assert len(plan) == docs.count() and all(0 <= r["copies"] <= 2 for r in plan)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in plan)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_near_duplicates(sets, which):
    docs = sets[which]
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    classes = {(r["class_id"], r["class_hash"]) for r in found}
    assert out.count() == len(classes)
    if which == "odd":
        of = {(r["doc_id"], r["text_hash"]): r["class_id"] for r in found}
        empty = {v for (i, _), v in of.items() if i in (1, 2, 3)}
        assert empty == {None}  # texts without words are copies of each other, the null id comes first


@pytest.mark.parametrize("which", ["odd", "none"])
def test_lines(sets, which):
    docs = sets[which]
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    if which == "odd":
        got = {r["doc_id"]: r for r in out.collect()}
        assert got[7]["n_removed"] >= 399 and got[1]["text"] is None and got[1]["n_lines"] == 0 and got[2]["n_lines"] == 1


@pytest.mark.parametrize("which", ["odd", "none"])
def test_records(spark, sets, which, tmp_path):
    import public_tokenizers

    path, docs = f"file://{tmp_path}/r", sets[which]
    index = records.write_records(docs, path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    rows = records.read_records(spark, path).orderBy("start").collect()
    assert index.count() == len(rows) == docs.count()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


@pytest.mark.parametrize("which", ["odd", "none"])
def test_html(sets, which):
    pages = sets[which].withColumnRenamed("source", "url").withColumn("html", F.concat(F.lit("<p>"), "text"))
    out = html.extract_pages(pages)
    assert out.columns == [c for c in pages.columns if c != "text"] + ["text"] and out.count() == pages.count()
    assert all(r["text"] is not None for r in out.collect())


@pytest.mark.parametrize("which", ["odd", "none"])
def test_host_rules(sets, which):
    rows = hostrules.judge_hosts(sets[which]).collect()
    assert len(rows) == sets[which].count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_leaks(sets, which):
    docs = sets[which]
    out = decontaminate.find_leaks(docs, sets["items"], offsets=True)
    assert out.columns == [c for c in docs.columns if c not in ("n_words", "hits")] + ["n_words", "hits", "items", "n_hit", "spans"]
    got = {r["doc_id"]: r for r in out.collect()}
    if which == "odd":
        assert got[8]["items"] == ["3"] and got[5]["items"] == ["1"] and got[1]["n_words"] == 0
    assert decontaminate.decontaminated(docs, sets["items"]).columns == docs.columns
    assert decontaminate.find_leaks(docs, sets["items"].where("false")).where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages(spark, sets, which, tmp_path):
    sets["labels"].write.parquet(f"{tmp_path}/labels.parquet")
    sets["items"].write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = sets[which].select(*(c for c in sets[which].columns))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "quality":  # with labels at random it may reject anything
            docs = spark.read.parquet(f"{tmp_path}/{name}")


def test_text_ids(spark):
    """Ids that are no numbers: passages, classes and lines take them, records refuse them."""
    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("b", f"one two\n{body}"), ("a", f"one two\n{body}"), ("c", "else")], "doc_id string, text string")
    assert {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {(r["doc_id"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()} == {("a", 0), ("b", 2), ("c", 0)}
    assert {frozenset((r["doc_id"], r["other_id"])) for r in passages.repeated_passages(docs).collect()} == {frozenset("ab")}
    with pytest.raises(TypeError):
        records.write_records(docs, "/nowhere", tokenizer="none")


def test_time_of_many_lines(spark):
    """Two copies of a text of 40,000 lines: the later one loses them all."""
    text = "\n".join(f"line number {i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], len(r["text"])) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: (40_000, 0, len(text)), 2: (40_000, 40_000, 0)}
