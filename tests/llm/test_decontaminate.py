import random

from lodestone.llm import decontaminate
from lodestone.llm.decontaminate import WORD


def brute(text, items, window=10):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, hit, found = WORD.findall(low), set(), set()
    for item, t in items:
        own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        for w in [own[i : i + window] for i in range(max(1, len(own) - window + 1))] if own else []:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


def corpus():
    rng = random.Random(9)
    pool = ["a", "B", "éa", "c1", "dd"]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 10, 12, 14])))) for i in range(14)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1].upper(), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))]
        docs.append((i, " - ".join(parts)))
    return items, docs


def test_equals_brute_force_in_one_block_and_in_many(spark):
    items, docs = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (32 << 20, 40):
        for r in decontaminate.find_leaks(df, bench, block_bytes=size, offsets=True).collect():
            n, hit, found = brute(r["text"], items)
            assert (r["n_words"], sorted(i for h in r["hits"] for i in range(h["first"], h["last"] + 1)), r["items"]) == (n, hit, found)
            assert r["n_hit"] == len(hit)
            cut = [w for s in r["spans"] for w in decontaminate.normal_words(r["text"][s["start"] : s["stop"]])]
            assert len(cut) == len(hit)
