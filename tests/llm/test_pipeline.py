"""The pipeline against a plain version of its stages."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import decontaminate, mixing, quality
from lodestone.llm.common import fold_of
from tests.llm.test_neardup import brute

D = "/root/testdata/sf0.001"


def test_stages_equal_plain_code(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit_ranking(docs, spark.read.parquet(f"{D}/labels.parquet"), where=fold_of("doc_id", 5) != 0)
    good = {i: r["text"] for i, r in rows.items() if model.score(quality.features(r["text"])[None, :])[0] >= 0.3}
    classes = brute(good)
    single = {i: t for i, t in good.items() if classes[i] == i}
    items = spark.read.parquet(f"{D}/benchmark.parquet").collect()
    bad = {w for r in items for w in decontaminate.windows(r["text"], 10)}

    def leaks(text):
        w = decontaminate.normal_words(text)
        return any(tuple(w[i : i + n]) in bad for n in {len(b) for b in bad} for i in range(len(w) - n + 1))

    clean = {i: t for i, t in single.items() if not leaks(t)}
    kept = docs.where(docs["doc_id"].isin(list(clean)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
    coder, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(clean):
        ids = np.array(coder.encode(clean[i], add_special_tokens=False).ids + [2], "<u4")
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, D).collect())
    assert got == want


def test_planted_copies_leaks_and_clean_documents(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(120)) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200 + i, docs[i][1] + " tail") for i in range(5, 10)]
    items = [(i, text(30)) for i in range(4)]
    docs += [(300 + i, text(50) + " " + items[i][1].upper() + " " + text(50)) for i in range(4)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    once = corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path))
    out = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, once, str(tmp_path)).collect()}
    assert out == set(range(60))


def test_stage_names():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and not [n for n, c in Counter(n for n, _ in corpus_pipeline.STAGES).items() if c > 1]
