import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")


CODER, PLAIN = records.Coder(PATH, 2, 2), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abAB'stlldΣσéÉñ 12٣.,!<|>_-\n\t\x0b\x1c\x85İßﬁ日本👋", "'s", "'LL", "<|endoftext|>", "don't", "é", "̸"]), max_size=20))
def test_coder_equals_the_tokenizer(parts):
    text = "".join(parts)
    assert np.frombuffer(CODER.encode(text), "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids + [2]


def test_round_trip(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    records.write_records(docs, f"file://{tmp_path}/r", tokenizer=PATH, shards=5)
    rows = records.read_records(spark, f"file://{tmp_path}/r").orderBy("start").collect()
    start = 0
    for given_, r in zip(docs.orderBy("doc_id").collect(), rows, strict=True):
        ids = np.array(PLAIN.encode(given_["text"], add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (given_["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_shuffled_reads_by_the_index(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = records.write_records(docs, f"file://{tmp_path}/r", tokenizer=PATH, shards=3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in index.orderBy("n_tokens").limit(20).collect():
        doc_id, ids = records.read_sequence(r["file"], r["offset"], r["length"])
        assert doc_id == r["doc_id"] and ids == CODER.encode(texts[doc_id])


def test_damage_is_noticed():
    data = bytearray(records.frame(b"payload") + records.frame(b""))
    stream = io.BytesIO(bytes(data))
    assert [records.read_record(stream) for _ in range(3)] == [b"payload", b"", None]
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        stream = io.BytesIO(bytes(bad))
        with pytest.raises(ValueError):
            while records.read_record(stream) is not None:
                pass
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(bytes(data[:-20])))
