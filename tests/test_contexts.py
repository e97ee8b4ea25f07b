"""JSON contexts, figures on the way, change sets, the vault, retriever instances."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import models, store
from lodestone.functions import context
from lodestone.operators import changes, chunking
from lodestone.plans.retrievers import RetrieverOperator
from lodestone.plans.tap import tap
from lodestone.snapshots import Conflict, SnapshotTable
from lodestone.sources import ingest, vault
from lodestone.types import TENANT, metadata


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_contexts(spark):
    c = context.create(F.col("t"))
    text = '{"a": {"b": [1, 2.5, "x"]}, "n": null, "yes": true}'
    r = one(spark, text, *(context.value(c, p, k).alias(n) for n, p, k in (("i", "$.a.b[0]", "int"), ("d", "$.a.b[1]", "double"), ("s", "$.a.b[2]", "string"), ("none", "$.n", "string"), ("bad", "$.a.b[2]", "int"), ("gone", "$.z.z", "int"), ("yes", "$.yes", "boolean"))))
    assert tuple(r) == (1, 2.5, "x", None, None, None, True)
    assert one(spark, " ", context.dumped(c))[0] == "{}" and one(spark, None, context.dumped(c))[0] == "{}" and one(spark, "3", context.dumped(c))[0] == "3"
    assert one(spark, "no json", context.dumped(context.create(F.col("t"), strict=False)))[0] is None
    for bad in (c, context.required(context.create(F.lit("{}")), "$.k", "int")):
        with pytest.raises(Exception, match="k|JSON|json"):
            one(spark, "no json", F.to_json(bad) if bad is c else bad)
    new = context.with_values(c, n=F.lit(5), s=F.lit('"q"'), z=F.lit(None).cast("int"), arr=F.array(F.lit(1)))
    assert one(spark, text, context.dumped(new))[0] == '{"a":{"b":[1,2.5,"x"]},"arr":[1],"n":5,"s":"\\"q\\"","yes":true,"z":null}'
    assert one(spark, text, context.dumped(context.without(c, "a", "n")))[0] == '{"yes":true}'
    batch = F.transform(context.create_batch(F.col("t")), context.dumped)
    assert [one(spark, t, batch)[0] for t in ('[1,{"a":2}]', '{"a":1}', "", "[]", " [7]")] == [["1", '{"a":2}'], ['{"a":1}'], [], [], ["7"]]


def test_sanitised_contexts(spark):
    s = context.dumped(context.sanitised(context.create(F.col("t"))))
    assert one(spark, '{"__protobuf_message__": "{\\"q\\": 1}"}', s)[0] == '{"q":1}'
    assert one(spark, '{"__mapping_data__": {"x": {"__protobuf_message__": "[1]"}, "y": 2}}', s)[0] == '{"x":[1],"y":2}'
    assert one(spark, "5", s)[0] == "5" and one(spark, '{"a": {"b": 1}}', s)[0] == '{"a":{"b":1}}'


def test_tap(spark):
    rows, seen = tap(spark.range(100), even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    assert rows.where("id < 10").count() == 10 and seen.get == {"rows": 100, "even": 50, "none": 0}


def test_change_sets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", i * 10) for i in range(6)], "id int, name string, v int")
    made = [
        (0, "update", 1, "a", None), (0, "update", 2, None, 7), (1, "delete", 5, None, None), (1, "update", 6, "late", 1), (2, "delete", 1, None, None), (2, "insert", 2, "again", None), (2, "update", 3, None, 9),
        (3, "insert", 1, "over", None), (9, "insert", 1, "new", 1), (9, "update", 2, "newer", None), (8, "update", 1, "nothing", 1), (7, "insert", 1, "x", 1), (7, "delete", 1, None, None), (4, "other", 1, "bad", 1),
    ]
    ch = spark.createDataFrame(made, "id int, op string, version int, name string, v int").repartition(3)
    want = {(0, "a", 7), (2, "again", 9), (3, "over", 30), (4, "n4", 40), (5, "n5", 50), (9, "newer", 1)}
    assert {tuple(r) for r in changes.applied(rows, ch).collect()} == want
    table = SnapshotTable(spark, f"file://{tmp_path}/t", rows.schema)
    table.append(rows)
    assert changes.commit(table, ch) == 2 and {tuple(r) for r in table.read().collect()} == want and table.read(1).count() == 6
    assert changes.applied(rows, ch.where("false")).count() == 6
    children = spark.createDataFrame([(10, 1), (11, 2), (12, 5), (13, 1)], "id int, thread_id int")
    gone = changes.cascade(ch, children)
    assert sorted(r["id"] for r in changes.applied(children, gone).collect()) == [11, 12]
    write = table.write
    table.write = lambda df: SnapshotTable(spark, table.path).append(rows.limit(1)) and write(df)
    with pytest.raises(Conflict):
        changes.commit(table, ch)


def test_runs(spark):
    kind = "run_id string, thread_id string, assistant_id string, version int, messages array<struct<role:string,content:string>>"
    asked = [("r1", "t1", "a", 1, [("user", "hi"), ("assistant", "yes"), ("user", "go")]), ("r2", "t2", "a", 1, [("assistant", "hi")]), ("r3", "t3", "a", 1, []), ("r4", "t4", "a", 1, [("user", "a"), ("user", "b")])]
    threads, messages, runs, refused = changes.created_with_thread(spark.createDataFrame(asked, kind))
    assert [r["id"] for r in threads.collect()] == ["t1"] and sorted(r["run_id"] for r in refused.collect()) == ["r2", "r3", "r4"]
    assert sorted((r["id"], r["role"]) for r in messages.collect()) == [("t1/0", "user"), ("t1/1", "assistant"), ("t1/2", "user")] and runs.first()["status"] == "queued"
    state = spark.createDataFrame([("r1", "requires_action"), ("r5", "requires_action"), ("r6", "in_progress"), ("r7", "completed"), ("r8", "queued")], "id string, status string")
    required = spark.createDataFrame([("r1", "c1"), ("r1", "c2"), ("r5", "c3"), ("r5", "c4")], "run_id string, tool_call_id string")
    outputs = spark.createDataFrame([("r1", "c1", "x"), ("r1", "c2", "y"), ("r5", "c3", "z"), ("r6", "c9", "q")], "run_id string, tool_call_id string, output string")
    ready, missing = changes.submitted(state, required, outputs, F.lit(9))
    after = {r["id"]: r["status"] for r in changes.applied(state, ready).collect()}
    assert after == {"r1": "queued", "r5": "requires_action", "r6": "in_progress", "r7": "completed", "r8": "queued"} and [tuple(r) for r in missing.collect()] == [("r5", "c4")]
    after = {r["id"]: r["status"] for r in changes.applied(state, changes.cancelling(state, F.lit(True), F.lit(9))).collect()}
    assert after == {"r1": "cancelled", "r5": "cancelled", "r6": "cancelling", "r7": "completed", "r8": "cancelled"}


def test_vault(spark, tmp_path):
    import hashlib

    bodies = {f"f{i}": f"content {i}".encode() for i in range(6)}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(b)
    kind = "name string, algorithm string, checksum string, metadata map<string,string>, path string"
    how = ["md5", "sha1", "sha256"]
    listed = [(n, how[i % 3], hashlib.new(how[i % 3], b).hexdigest().upper(), {"k": n}, f"{tmp_path}/{n}") for i, (n, b) in enumerate(bodies.items())]
    resources = spark.createDataFrame(listed, kind)
    kept = vault.FileVault(spark, f"file://{tmp_path}/vault")
    calls = []

    def fetch(r):
        calls.append(sorted(x["name"] for x in r.select("name").collect()))
        return vault.from_files()(r)

    assert {r["name"]: bytes(r["content"]) for r in kept.get(resources, fetch).collect()} == bodies
    assert kept.get(resources, fetch).count() == 6 and len(calls) == 1 and kept.verify().isEmpty() and kept.entries().where("metadata['k'] = name").count() == 6
    # A damaged entry is noticed and fetched again once.
    hit = F.col("name") == "f2"
    kept.table.rewrite(lambda df: df.where(hit), lambda df: df.withColumn("content", F.when(hit, F.lit(b"broken")).otherwise(F.col("content"))), "damage")
    assert [r["name"] for r in kept.verify().collect()] == ["f2"]
    assert kept.repair(resources, fetch) == 1 and calls[1:] == [["f2"]] and kept.verify().isEmpty() and kept.repair(resources, fetch) == 0
    # What is broken at first is fetched once more; what is broken twice fails and leaves nothing.
    (tmp_path / "g").write_bytes(b"right")
    tries = []

    def flaky(r):
        tries.append(1)
        found = vault.from_files()(r)
        return found.withColumn("content", F.lit(b"wrong")) if len(tries) == 1 else found

    new = spark.createDataFrame([("g", "sha1", hashlib.sha1(b"right").hexdigest(), None, f"{tmp_path}/g")], kind)
    assert bytes(kept.get(new, flaky).first()["content"]) == b"right" and len(tries) == 2
    bad = spark.createDataFrame([("h", "md5", "00", None, f"{tmp_path}/g")], kind)
    before = kept.table.snapshot().version
    with pytest.raises(ValueError, match="h"):
        kept.get(bad, vault.from_files())
    assert kept.table.snapshot().version == before and kept.remove("g") == 1 and kept.entries().count() == 6


def test_retriever_instances(spark):
    documents = store.DocumentTable(spark, "tenant_docs", TENANT, replace=True)
    registry = store.Registry(spark, "tenant_registry")
    model = models.HashedWords(64)
    operator = RetrieverOperator(registry, documents, models.embedding(model), 64, parent_size=60, child_size=20, child_overlap=0)
    docs = lambda *texts: spark.createDataFrame([(f"{texts[0].split()[2]}{i}", t, "ROOT", 1, "f", 0, 0) for i, t in enumerate(texts)], "id string, text string, parent_doc_id string, page_no int, file_source string, start_index int, end_index int")
    for i in ("one", "two"):
        operator.provision(i)
    operator.writer("one").ingest(docs("a red fox runs over green hills and far away into the dark wood", "blue rivers run north"))
    operator.writer("two").ingest(docs("a red car stands still"))
    asked = model.embed(["red fox"])[0]
    assert "fox" in operator.writer("one").retrieve(asked, 3).first()["text"] and all("car" in r["text"] for r in operator.writer("two").retrieve(asked, 9).collect())
    both = operator.reader(["one", "two"], models.ranking(models.SharedWords(), "red car")(F.col("text")))(asked, 5).collect()
    assert "car" in both[0]["text"] and {r["vs_id"] for r in both} == {"one", "two"}
    assert operator.cleanup("one") and not operator.cleanup("one") and documents.read().select("vs_id").distinct().count() == 1
    with pytest.raises(ValueError):
        operator.writer("one")
    with pytest.raises(ValueError):
        RetrieverOperator(registry, store.DocumentTable(spark, "no_tenant", metadata(n="int32")), models.embedding(model), 64)
    operator.cleanup("two")
    documents.drop()


def test_remove_by_filter(spark):
    from lodestone.operators.filters import Term
    from lodestone.plans.retrievers import MultiVectorRetriever, chunk_children

    documents = store.DocumentTable(spark, "filter_docs", replace=True)
    vectors = store.VectorTable(spark, "filter_vectors", models.embedding(models.HashedWords(64)), 64, replace=True)
    both = MultiVectorRetriever(documents, vectors, chunk_children(chunking.RecursiveSplitter(size=12)))
    rows = [(f"p{i}", "some text that is cut", "ROOT", i, "f", 0, 0) for i in range(4)]
    both.ingest(spark.createDataFrame(rows, "id string, text string, parent_doc_id string, page_no int, file_source string, start_index int, end_index int"))
    n = vectors.count()
    assert both.remove(Term("page_no", 2)) == 1 and documents.count() == 3 and vectors.count() == n * 3 // 4
    documents.drop()
    vectors.drop()


def test_mixed_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    for n in (0, 1):
        spark.range(5).selectExpr(f"concat('row', id + {n * 5}) as t", "id").coalesce(1).write.parquet(f"{tmp_path}/sub/p{n}")
    rows = ingest.directory(spark, str(tmp_path), types=("txt", "parquet")).collect()
    assert sorted(r["text"] for r in rows) == sorted(["plain", *(f"row{i}" for i in range(10))])
    numbers = {}
    for r in rows:
        numbers.setdefault(r["file_source"], []).append(r["page_no"])
    assert sorted(sorted(x) for x in numbers.values()) == [[1], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]]


def test_first_places_of_long_texts():
    import random
    import time

    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    data = " ".join(words).encode() + b" end" * 5000
    parts = [data[i : i + n] for i in range(0, len(data) - 500, 311) for n in (3, 15, 16, 40, 400)] + [b"never there at all", b"", b"end end end end end end"]
    assert chunking.first_places(data, parts) == [data.find(p) for p in parts]
    big = data * 6
    big = b"".join(b"%d %s\n" % (i, big[i * 400 : i * 400 + 390]) for i in range(len(big) // 400))
    cut = [big[i : i + 400] for i in range(0, len(big), 380)]
    began = time.process_time()
    assert chunking.first_places(big, cut)[-1] > 0 and time.process_time() - began < 4
