"""Fingerprints of long documents: every anchor with its position, and likeness by brute force over all of them."""

import random
import re
from collections import Counter, defaultdict

import pytest

from wordloom.llm import syncmers

RNG = random.Random(5)


def words(n):
    return " ".join(f"{RNG.randrange(10**7):x}" for _ in range(n))


def test_fingerprint_has_all_anchors(spark, tmp_path):
    passage = words(60)
    texts = {i: words(2500) + " " + passage + " " + words(2500) for i in (1, 2)} | {3: words(1500), 4: "ab " * 300, 5: "", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in syncmers.op9_document_fingerprints(spark, str(tmp_path)).collect()}
    all_of = defaultdict(set)
    for r in syncmers.anchors(docs).collect():
        all_of[r["doc_id"]].add((r["pos"], r["anchor"] & 0xFFFFFFFF))
    for i in (1, 2, 3, 4):
        assert len(all_of[i]) > 64
        assert {divmod(int(x, 16), 1 << 32) for x in got[i]["fingerprint"].split()} == all_of[i]
    found = {i: sorted((p, a) for p, a in all_of[i]) for i in texts}
    found[5] = found[6] = []
    for i, after in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5)):
        assert got[i]["near_next"] == pytest.approx(brute_likeness(found[i], found[after]))
    assert 0 < got[2]["near_next"] < 0.1  # the shared passage


def brute_likeness(a, b):
    """Dice of the anchors at displacements that at least three share; of an anchor's places neighbours meet, and no anchor
    counts more often than it has partners."""
    if not a and not b:
        return 1.0
    places = defaultdict(list)
    for side, found in enumerate((a, b)):
        for pos, anchor in found:
            places[anchor].append((pos, side))
    moves = Counter()
    for at in places.values():
        at.sort()
        for (p, x), (q, y) in zip(at, at[1:], strict=False):
            if x != y:
                moves[q - p if x == 0 else p - q] += 1
    least = min(3, len(a), len(b))
    partners = sum((Counter(x for _, x in a) & Counter(x for _, x in b)).values())
    return 2 * min(partners, sum(n for n in moves.values() if n >= least)) / (len(a) + len(b))


def brute_anchors(spark, text):
    """Closed syncmers by the definition: the smallest inner substring is the first or the last one."""
    pieces = re.findall(syncmers.PIECE, text)
    hashes = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "i int, p string").selectExpr("i", "xxhash64(p) h").orderBy("i").collect()
    pairs = [(x["h"], y["h"]) for x, y in zip(hashes, hashes[1:], strict=False)]
    inner = [r["g"] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").selectExpr("i", "xxhash64(a, b) g").orderBy("i").collect()]
    wide = syncmers.K - syncmers.S
    closed = [(i, inner[i], inner[i + 2], inner[i + wide]) for i in range(len(inner) - wide) if min(inner[i : i + wide + 1]) in (inner[i], inner[i + wide])]
    return {(r["i"], r["v"] & 0xFFFFFFFF) for r in spark.createDataFrame(closed, "i int, a long, b long, c long").selectExpr("i", "hash(a, b, c) v").collect()}


def test_anchors_are_closed_syncmers(spark):
    text = words(120)
    got = {(r["pos"], r["anchor"] & 0xFFFFFFFF) for r in syncmers.anchors(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == brute_anchors(spark, text) and len(got) > 50


def test_likeness_follows_what_texts_share(spark):
    """Recall against the true overlap: near copies are near, a moved passage still matches, unrelated texts do not."""
    rows, share = [], []
    for kept in (1.0, 0.9, 0.7, 0.5, 0.2, 0.0):
        for _ in range(10):
            a = words(200).split()
            n = int(200 * kept)
            b = words(RNG.randrange(0, 30)).split() + a[:n] + words(200 - n).split()
            rows.append((len(rows), " ".join(a), " ".join(b)))
            share.append(2 * n / (len(a) + len(b)))
    df = spark.createDataFrame(rows, "i long, a string, b string").selectExpr("*")
    got = df.select("i", syncmers.likeness(syncmers.positioned(df.a), syncmers.positioned(df.b)).alias("x")).collect()
    assert all(abs(r["x"] - share[r["i"]]) < 0.08 for r in got)
    near = [r["x"] for r in got if share[r["i"]] >= 0.8]
    assert sum(x >= 0.75 for x in near) >= 0.9 * len(near) and all(r["x"] < 0.05 for r in got if share[r["i"]] == 0)


def test_buckets_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "STEP", 4)
    bounds = sorted(RNG.sample(range(1000), 14))
    df = spark.range(1000)
    got = df.select("id", syncmers._bucket(df.id, bounds).alias("b")).collect()
    assert all(r["b"] == sum(x < r["id"] for x in bounds) for r in got)


def test_likeness_of_repetitive_and_unspaced_texts(spark):
    """The true overlap is known by construction: a repeated passage counts as often as both texts have it."""
    phrase, other = words(12), words(60)  # other: long beside a k-mer, whose ends meet what stands beside it
    lines = [words(9) for _ in range(5)]
    chinese = "".join(chr(0x4E00 + RNG.randrange(3000)) for _ in range(600))
    rest = "".join(chr(0x4E00 + RNG.randrange(3000)) for _ in range(300))
    mixed = [x for _ in range(40) for x in (words(9), RNG.choice(lines))]
    cases = [
        (" ".join([phrase] * 40), " ".join([phrase] * 20) + " " + words(240), 0.5),
        (" ".join([phrase] * 40), " ".join([phrase] * 41), 80 / 81),
        (" ".join([phrase] * 40), " ".join([phrase] * 10), 0.4),
        (" ".join([words(60), other] * 8), " ".join([other] * 16), 0.5),
        ("\n".join(mixed), "\n".join(mixed[:40]) + "\n" + "\n".join(words(9) for _ in range(40)), 0.5),
        (chinese, "x" + chinese, 1.0),
        (chinese, chinese[:300] + "，" + chinese[300:], 1.0),
        (chinese, chinese[:300] + rest, 0.5),
        (chinese, rest + rest[::-1], 0.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i long, a string, b string")
    got = {r["i"]: r["x"] for r in df.select("i", syncmers.likeness(syncmers.positioned(df.a), syncmers.positioned(df.b)).alias("x")).collect()}
    assert {i: (x, cases[i][2]) for i, x in got.items() if abs(x - cases[i][2]) > 0.1} == {}
