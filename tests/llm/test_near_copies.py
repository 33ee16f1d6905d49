"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from wordloom.llm import resemblance

RNG = random.Random(11)


def brute(texts):
    """A root for each text: components of five-word Jaccard similarity of at least 0.8."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))]


def edited(words, n):
    out = list(words)
    for at in RNG.sample(range(len(out)), n):
        out[at] = f"new{RNG.randrange(10**9)}"
    return out


def test_near_dedup_stage_is_jaccard(spark):
    texts = [None, "", "one", "One", "two words"]
    for size in (30, 100, 400):
        for _ in range(4):
            base = [f"w{RNG.randrange(3000)}" for _ in range(size)]
            # near and not so near copies, and chains of them
            texts += [" ".join(base), *(" ".join(edited(base, n)) for n in (1, size // 60, size // 45, size // 30, size // 10))]
            step = base
            for _ in range(5):
                step = edited(step, max(1, size // 70))
                texts.append(" ".join(step))
    # a large group whose members are close to one text and mostly not to each other
    base = [f"g{RNG.randrange(3000)}" for _ in range(200)]
    texts += [" ".join(edited(base, 4)) for _ in range(60)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = sorted(set(brute(texts)))
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want and len(want) < len(texts) and kept.columns == docs.columns
    assert resemblance.keep_one(docs.limit(0)).count() == 0
