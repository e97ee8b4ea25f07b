import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import models, store
from lodestone.operators import aggregates, bm25, entities, retrieval, search, validate
from lodestone.operators.chunking import RecursiveSplitter
from lodestone.operators.filters import Bool, Find, Range, Sorter, Term
from lodestone.plans import chains
from lodestone.sources import ingest
from lodestone.streaming import jobs
from lodestone.types import PRESET, described, document, metadata

ANIMALS = [("zebra", "Hippotigris", 20, 1, "Africa"), ("lion", "Panthera", 14, 0, "Africa"), ("bison", "Bison", 9, 0, "North America")]


def test_documents(spark):
    fields = metadata(name="varchar", genus="varchar", age="int32", sex="int32", origin="varchar")
    t = store.DocumentTable(spark, "animals", fields, replace=True)
    rows = spark.createDataFrame([(f"a {n}", n, g, a, s, o) for n, g, a, s, o in ANIMALS], "text string, name string, genus string, age int, sex int, origin string")
    added = t.add(rows)
    assert added.affected_rows == 3 and added.ids.count() == 3 and added.failed.isEmpty() and t.count() == 3
    ident = t.find(Find(Term("name", "lion"))).first()["id"]
    assert t.get([ident]).first()["genus"] == "Panthera" and t.get_many(added.ids).count() == 3
    assert [r["name"] for r in t.find(Find(None, [Sorter("age")], 2, 1)).collect()] == ["lion", "bison"]
    assert t.update({"age": F.col("age") + 1}, Term("name", "zebra")) == 1 and t.find(Find(Term("age", 21))).count() == 1
    assert t.delete_where(Term("origin", "North America")) == 1 and t.count() == 2
    assert t.delete([ident]) == 1 and t.count() == 1
    with pytest.raises(ValueError):
        t.delete([])
    assert t.delete_where() == 1 and t.count() == 0
    t.drop()


def test_rejected_rows(spark):
    t = store.DocumentTable(spark, "picky", metadata(n="int32", f="double"), replace=True)
    rows = spark.createDataFrame([("ok", "1", 2.0, "x"), (" ", "1", 2.0, "x"), ("text", "many", None, "x"), (None, None, None, "x")], "text string, n string, f double, extra string")
    got = t.add(rows)
    assert got.affected_rows == 1 and t.read().first()["n"] == 1
    assert sorted(v for r in got.failed.collect() for v in r["violations"]) == ["blank_text: text", "blank_text: text", "wrong_type: n"]
    assert t.add(rows.drop("f")).affected_rows == 0 and t.add(rows, allow_unknown=False).affected_rows == 0
    checks = validate.violations(rows, document(PRESET))
    assert "missing: page_no" in rows.select(checks.alias("v")).first()["v"]
    assert described(PRESET, page_no="p")["page_no"].metadata == {"comment": "p"}
    with pytest.raises(ValueError):
        metadata(x="bytes")
    t.drop()


def test_vectors_find_themselves(spark):
    registry = store.Registry(spark, "registry")
    embed = models.embedding(models.HashedWords(64))
    t = registry.create("vs-1", embed, 64)
    rng = np.random.default_rng(3)
    rows = [(str(i), rng.random(64).tolist(), None if i % 2 else "even", i) for i in range(200)]
    frame = spark.createDataFrame(rows, "text string, vector array<double>, file_source string, page_no int")
    for name, kind in (("parent_doc_id", "string"), ("start_index", "int"), ("end_index", "int")):
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    assert t.add(frame).affected_rows == 200
    for i in (0, 57, 199):
        assert t.search(rows[i][1], 1).first()["text"] == str(i)
        other = t.search(rows[i][1], 3, Bool(must_not=[Term("page_no", i)])).collect()
        assert len(other) == 3 and str(i) not in {r["text"] for r in other}
    assert all(r["file_source"] == "even" for r in t.search(rows[1][1], 5, Term("file_source", "even")).collect())
    assert t.search(rows[0][1]).count() == 10 and search.clamped(10**6) == 10_000
    with pytest.raises(ValueError):
        t.search([1.0])
    assert registry.load("vs-1", embed, 64).count() == 200 and registry.load("vs-2", embed, 64) is None
    with pytest.raises(ValueError):
        registry.create("vs-1", embed, 64)
    assert registry.remove("vs-1") and not registry.remove("vs-1") and registry.list().isEmpty()


def test_batches_of_queries(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 8)).astype(float)
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<float>").repartition(5)
    asked = df.where("id < 20").select(F.col("id").alias("query_id"), "vector")
    unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    for block in (20_000, 6):
        got = {}
        for r in search.top_k_batch(df, asked, 6, block=block).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], round(r["similarity"], 9))
        assert 7 not in got and len(got) == 19
        for q, ranks in got.items():
            s = unit @ unit[q]
            want = sorted((i for i in range(300) if v[i].any()), key=lambda i: (-round(s[i], 9), i))[:6]
            assert {round(x, 9) for _, x in ranks.values()} == {round(s[i], 9) for i in want}


def test_retrieval(spark):
    parents = spark.createDataFrame([("p1", "parent one"), ("p2", "parent two"), ("p3", "x")], "id string, text string")
    children = spark.createDataFrame([("p1", 0.5), ("p1", 0.9), ("p3", 0.7), (None, 1.0), ("gone", 1.0)], "parent_doc_id string, similarity double")
    assert sorted(r["id"] for r in retrieval.parents_of(children, parents).collect()) == ["p1", "p3"]
    assert [r["id"] for r in retrieval.ranked_parents(children, parents).collect()] == ["p1", "p3"]
    scored = parents.withColumn("similarity", F.length("text"))
    assert retrieval.context_of(scored).first()["context"] == "parent one\nparent two\nx\n"
    assert retrieval.guided_search(scored.withColumn("file_source", F.col("id")), 2, lambda names: names) == ["p1", "p2"]
    fused = {r["id"]: r["score"] for r in retrieval.fused([parents.withColumn("rank", F.lit(1)), parents.where("id = 'p1'").withColumn("rank", F.lit(2))]).collect()}
    assert max(fused, key=fused.get) == "p1"
    with pytest.raises(ValueError):
        retrieval.multi_query(lambda q, k: parents, ["one"])
    assert retrieval.multi_path([parents], F.lit(0), 1).count() == 3
    ranked = retrieval.reranked(parents, models.ranking(models.SharedWords(), "parent two")(F.col("text")), 1).first()
    assert ranked["id"] == "p2" and ranked["rerank_score"] == 1.0


def test_bm25_tokens(spark):
    assert bm25.query_tokens("Être, l'été 42 x_y x") == ["etre", "l", "ete", "x", "y"]
    df = spark.createDataFrame([(1, "Être l'été"), (2, None), (3, "the été été")], "id int, text string")
    index = bm25.build(df, stopwords=frozenset(["the"]))
    assert {r["id"]: r["length"] for r in index.lengths.collect()} == {1: 3, 2: 0, 3: 2}
    assert [r["id"] for r in bm25.top_k(df, index, "ÉTÉ the").collect()] == [3, 1] and bm25.top_k(df, index, "the").isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("one\n\ntwo")
    (tmp_path / "in/sub/b.md").write_text("# head")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>t{i};</w:t></w:r></w:p>" for i in range(45))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "in/c.docx").write_bytes(data.getvalue())
    rows = ingest.directory(spark, f"{tmp_path}/in").collect()
    assert sorted((r["file_source"][-5:], r["page_no"], r["text"][:3]) for r in rows) == [("/b.md", 1, "# h"), ("a.txt", 1, "one"), (".docx"[-5:], 1, "t0;"), (".docx", 2, "t20"), (".docx", 3, "t40")] or len(rows) == 5
    assert ingest.directory(spark, f"{tmp_path}/in", pattern="sub/").count() == 1
    chunks = ingest.load(ingest.text_files(spark, f"{tmp_path}/in/a.txt", source="src"), RecursiveSplitter(size=4)).collect()
    assert [r["text"] for r in sorted(chunks, key=lambda r: r["page_no"])] == ["one", "two"] and chunks[0]["file_source"] == "src"
    sums = {r["path"][-5:]: (r["length"], r["md5"]) for r in ingest.checksums(spark, f"{tmp_path}/in/a.txt").collect()}
    assert sums == {"a.txt": (8, __import__("hashlib").md5(b"one\n\ntwo").hexdigest())}
    assert ingest.reader_for("X.TXT") is ingest.text_files and ingest.reader_for("x.zip") is None
    with pytest.raises(ValueError):
        ingest.reader_for("x.zip", strict=True)


def test_mappings():
    assert ingest.column_mapping("0:t, 1:m:name:int64") == [(0, "text", None, None), (1, "metadata", "name", "int64")]
    for bad in ("1:m:name:int64", "0:x", "a:t", "0:t,1:m:name", "0:t,1:m:n:bytes"):
        with pytest.raises(ValueError):
            ingest.column_mapping(bad)


def test_chains(spark):
    df = spark.createDataFrame([("q1", "user: hi"), ("q2", "")], "question string, history string")
    upper = models.generation(models.Template(str.upper))
    found = {r["question"]: r for r in chains.rag(df, lambda d: d.withColumn("context", F.lit("c")), upper, upper, history="history").collect()}
    assert found["q2"]["asked"] == "q2" and found["q1"]["asked"].endswith("STANDALONE QUESTION:") and found["q2"]["answer"] == "CONTEXT:\nC\nQUESTION: Q2\nANSWER:"
    row = spark.range(1).select(
        chains.lines_of(F.lit(" a \n\n b")).alias("l"), chains.parsed(F.lit('Sure: {"x": 3}'), "x int").alias("p"),
        chains.planned(F.lit('1. search("a, b")\nnoise\n2. join()')).alias("plan"), chains.react(F.lit("Thought: t\nAction: look\nAction Input: here")).alias("r"),
        chains.react(F.lit("Thought: t\nFinal Answer: done")).alias("f"), chains.with_results(F.lit("$1 and ${2}, $12"), F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two"))).alias("w"),
        chains.few_shot("p", "{a}!", [{"a": "x"}, {"a": "toolong"}], "s {q}", most_chars=4, q=F.lit("?")).alias("few"),
    ).first()
    assert row["l"] == ["a", "b"] and row["p"]["x"] == 3 and [(p["index"], p["name"], p["arguments"]) for p in row["plan"]] == [(1, "search", '"a, b"'), (2, "join", "")]
    assert (row["r"]["thought"], row["r"]["action"], row["r"]["action_input"]) == ("t", "look", "here") and row["f"]["final_answer"] == "done"
    assert row["w"] == "one and two, $12" and row["few"] == "p\nx!\ns ?"
    tasks = spark.createDataFrame([(1, [], True), (2, [1], False), (3, [1, 2], False)], "index int, dependencies array<int>, done boolean")
    assert [r["index"] for r in chains.ready_tasks(tasks).collect()] == [2]
    with pytest.raises(ValueError):
        chains.sequence(None)
    parts = chains.split_branch(F.col("id") > 2, lambda d: d.withColumn("big", F.lit(True)), lambda d: d)
    assert parts(spark.range(5)).where("big").count() == 2


def test_summaries(spark):
    shorten = models.generation(models.Template(lambda t: "".join(x[0] for x in t.split("\n"))))
    df = spark.createDataFrame([("f", i, f"{chr(97 + i)} text") for i in range(20)] + [("g", 0, "zz")], "file_source string, page_no int, text string")
    got = {r["file_source"]: r["summary"] for r in chains.summaries(df, shorten, 6).collect()}
    assert got.keys() == {"f", "g"} and got["g"] == "z" and got["f"][0] == "a"


def plain_packs(sizes, limit):
    out, held, pack = [], 0, 1
    for i, n in enumerate(sizes):
        if i and held + n >= limit:
            held, pack = 0, pack + 1
        held += n
        out.append(pack)
    return out


@pytest.mark.parametrize("limit", [1, 100])
def test_packs_equal_a_greedy_loop(spark, limit):
    rng = np.random.default_rng(limit)
    sizes = {"a": rng.integers(0, 6, 900), "b": rng.integers(0, 250, 60), "c": np.zeros(9, int), "d": [limit], "e": [3 * limit] * 5 + [0, 0, limit - 1, 0, 1], None: [1, limit]}
    rows = [(g, i, "x" * int(n), "own") for g, ns in sizes.items() for i, n in enumerate(ns)]
    out = chains.packs(spark.createDataFrame(rows, "g string, o int, text string, s string").repartition(3), limit, by="g", order="o")
    assert out.columns == ["g", "o", "text", "s", "pack"]
    got = {}
    for r in out.orderBy("o").collect():
        got.setdefault(r["g"], []).append(r["pack"])
    assert got == {g: plain_packs([int(n) for n in ns], limit) for g, ns in sizes.items()}


def test_no_packs(spark):
    assert chains.packs(spark.createDataFrame([], "g string, o int, text string"), 5, by="g", order="o").isEmpty()


def test_summaries_of_long_texts_end(spark):
    """Texts of the limit and more, which no pack takes two of, are joined in pairs."""
    df = spark.createDataFrame([("f", i, chr(97 + i) * 9) for i in range(5)], "file_source string, page_no int, text string")
    got = chains.summaries(df, lambda t: F.regexp_replace(t, "\n", ""), 5).first()
    assert got["summary"] == "".join(chr(97 + i) * 9 for i in range(5))


def test_entities(spark):
    files = spark.createDataFrame([(1, "completed"), (1, "failed"), (2, "in_progress"), (3, "completed"), (4, "cancelled"), (4, "failed")], "batch_id int, status string")
    assert {r["batch_id"]: r["status"] for r in entities.batch_status(files).collect()} == {1: "failed", 2: "in_progress", 3: "completed", 4: "cancelled"}
    assert entities.cancelled(files, F.col("batch_id") == 2).where("status = 'cancelled'").count() == 2
    assert aggregates.status_counts(files.where("false"), ["failed"]).first().asDict() == {"failed": 0, "total": 0}
    assert aggregates.numeric(files.agg(F.count("*").alias("n"), F.avg("batch_id").alias("m"), F.max("status").alias("s"), F.max(F.lit(None).cast("int")).alias("z"))) == ({"n": 6}, {"m": 2.5})
    stores = spark.sql("select 1 id, 2 days, timestamp'2024-01-01' last_active_at union all select 2, 0, timestamp'2020-01-01' union all select 3, 9, timestamp'2024-01-01'")
    assert [r["id"] for r in entities.expired(stores, F.lit("2024-01-05").cast("timestamp")).collect()] == [1]
    threads = spark.createDataFrame([("t1",), ("t2",)], "id string")
    runs = spark.createDataFrame([("t1", "in_progress"), ("t2", "completed")], "thread_id string, status string")
    free = entities.can_delete(runs, threads)
    assert [r["id"] for r in free.collect()] == ["t2"] and [t.count() for t in entities.without_threads(free, runs, runs)] == [1, 1]
    batches = spark.createDataFrame([(1, None, 5), (2, 1, 1), (3, None, 2)], "id int, sanity_check_at int, modified_at int")
    assert [r["id"] for r in entities.pending(batches, 1).collect()] == [3]


def test_streams(spark, tmp_path, small):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "id int, text string")
    docs.write.parquet(f"{tmp_path}/src")
    for _ in range(2):  # the second start finds nothing new
        jobs.ingest(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck", RecursiveSplitter(size=6), schema="id int, text string").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["four", "one", "three", "two"]
    tasks = [(i, c) for i, c in enumerate("a" * 5 + "b" * 4 + "c" * 6 + "d" * 6)]
    spark.createDataFrame(tasks, "task_id int, category string").write.parquet(f"{tmp_path}/tasks")
    stream = spark.readStream.schema("task_id int, category string").parquet(f"{tmp_path}/tasks")
    good, bad = (lambda t: t.withColumn("ok", F.lit(True))), (lambda t: t.withColumn("ok", F.lit(False)))
    jobs.run_tasks(stream, {"a": good, "b": good, "c": bad}, f"{tmp_path}/done", f"{tmp_path}/ck2").awaitTermination()
    counts = {r["outcome"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/done").groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert counts == {"handled": 9, "failed": 6, "unhandled": 6}
    states = [(1, 1, "in_progress", 1), (1, 1, "completed", 2), (2, 1, "completed", 1), (3, 2, "in_progress", 1)]
    spark.createDataFrame(states, "file_id int, batch_id int, status string, ts int").write.parquet(f"{tmp_path}/states")
    jobs.supervise(spark.readStream.schema("file_id int, batch_id int, status string, ts int").parquet(f"{tmp_path}/states"), f"{tmp_path}/st", f"{tmp_path}/ck3").awaitTermination()
    assert {r["batch_id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/st").collect()} == {1: "completed", 2: "in_progress"}
    events = spark.read.parquet(f"{small}/events.parquet")
    assert jobs.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_ranges_are_exclusive_by_default(spark):
    assert spark.range(5).where(Range("id", 1, 3).column()).count() == 1


def test_dense_numbers(spark):
    from lodestone.plans.lineage import numbered

    df = spark.range(0, 1000, 3, 7).withColumn("v", (F.col("id") * 7919) % 1009)
    got = numbered(df, "v", "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1)) and [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert numbered(df.where("false"), "v", "n").isEmpty()


def test_ids_of_a_large_append_are_its_own(spark):
    t = store.DocumentTable(spark, "large", metadata(n="int32"), replace=True)
    rows = lambda low, high: spark.range(low, high).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.col("id").cast("int").alias("n"))
    first, second = t.add(rows(0, 10)), t.add(rows(10, 10_110))
    assert first.affected_rows == 10 and second.affected_rows == 10_100 and second.ids.count() == 10_100
    assert t.get_many(second.ids).agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (10, 10_109, 10_100)
    assert t.get_many(first.ids).count() == first.ids.count() == 10 and t.count() == 10_110
    t.drop()


def parent_rows(spark):
    texts = {"p1": "the red house stands here. it is old and empty.", "p2": "a blue river runs north. boats go down it.", "p3": "green hills and sheep. grass all over."}
    frame = spark.createDataFrame(list(texts.items()), "id string, text string")
    for name, kind in (("parent_doc_id", "string"), ("page_no", "int"), ("file_source", "string"), ("start_index", "int"), ("end_index", "int")):
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame


@pytest.mark.parametrize("kind", ["chunks", "sizes", "tokens", "summary", "questions"])
def test_retrievers_over_two_stores(spark, kind):
    from lodestone.operators.tokenizing import BytePairs
    from lodestone.plans import retrievers

    tokens = BytePairs(((116, 104), (256, 101)))
    children = {
        "chunks": retrievers.chunk_children(RecursiveSplitter(size=24)), "sizes": retrievers.chunk_sizes([12, 30]), "tokens": retrievers.chunk_sizes([20], lambda t: len(tokens.encode(t))),
        "summary": retrievers.summary_children(lambda t: F.split(t, r"\. ")[0]), "questions": retrievers.question_children(lambda t: F.regexp_replace(t, r"\. ?", "\n")),
    }[kind]
    model = models.HashedWords(64)
    documents = store.DocumentTable(spark, f"two_{kind}_docs", replace=True)
    vectors = store.VectorTable(spark, f"two_{kind}_vectors", models.embedding(model), 64, replace=True)
    both = retrievers.MultiVectorRetriever(documents, vectors, children)
    assert both.ingest(parent_rows(spark)).affected_rows == 3
    held = vectors.read().groupBy("parent_doc_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert {r["parent_doc_id"] for r in held} == {"p1", "p2", "p3"} and all(r["n"] == r["ids"] == (1 if kind == "summary" else 2 if kind == "questions" else r["n"]) for r in held)
    asked = model.embed(["a blue river runs north"])[0]
    found = both.retrieve(asked, 30).collect()
    assert found[0]["id"] == "p2" and len(found) == len({r["id"] for r in found})
    assert both.remove(["p2"]) == 1 and vectors.count(Term("parent_doc_id", "p2")) == 0 and {r["id"] for r in both.retrieve(asked, 30).collect()} == {"p1", "p3"}
    documents.drop()
    vectors.drop()


def test_stored_index_reads_its_folders(spark):
    df = spark.createDataFrame([(i, f"running runners number{chr(97 + i % 20)} house houses the") for i in range(60)], "id int, text string")
    index = bm25.build(df, stopwords=bm25.ENGLISH, stemming=True)
    assert {r["term"] for r in index.terms.where("id = 0").collect()} == {"run", "runner", "numbera", "hous"}
    got = bm25.top_k(df, index, "The Houses of numberb", 5)
    assert [r["id"] for r in got.collect()] == [1, 21, 41, 0, 2]
    plan = bm25.score(index, "house")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan or "folder#" in plan.split("PartitionFilters")[1][:80]
    with_filter = bm25.top_k(df, index, "house", 3, Range("id", 50))
    assert [r["id"] for r in with_filter.collect()] == [51, 52, 53]


def test_numbers_of_several_files(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("cast(id as string) as t").coalesce(1).write.parquet(f"{tmp_path}/{i}.parquet")
    rows = ingest.parquet_files(spark, [f"{tmp_path}/{i}.parquet" for i in range(3)], "0:t").collect()
    assert sorted(r["page_no"] for r in rows) == list(range(1, 31)) and {int(r["text"]) for r in rows} == set(range(30))
