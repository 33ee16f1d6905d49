"""Token counts, spelling variants and prefix tries against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wordloom.llm import prefixtrie, spelling, tokencounts

PATH = tokencounts._path(None)
ODD = [*"aab''''  \n\tst rev'll1 2³²!?., 　\u0085é漢字かな٣𝟘😀́​﻿<|>", "<|endoftext|>", "'s", "'re", "'ll", "  ", "\r\n", "don't", "\x1c"]


@pytest.fixture(scope="module")
def cut():
    return tokencounts.PreTokens(PATH)


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pre_tokens_are_the_librarys(cut):
    texts = odd_texts(3000, 5)
    found, added = defaultdict(list), Counter()
    for i, tokens, n in cut(texts):
        found[i] += tokens
        added[i] += n
    for i, t in enumerate(texts):
        if "<|endoftext|>" not in t:
            assert found[i] == [t[a:z] for _, (a, z) in cut.tokenizer.pre_tokenizer.pre_tokenize_str(t)], t
        assert added[i] == t.count("<|endoftext|>")


def test_parts_of_a_long_text_do_not_change_its_pre_tokens(cut, monkeypatch):
    monkeypatch.setattr(tokencounts, "PART", 50)
    text = " ".join(odd_texts(40, 6)).replace("<|endoftext|>", "") + " plain words that can be cut apart" * 9 + "x" * 300
    assert len(cut._parts(text)) > 5
    assert [t for _, tokens, _ in cut([text]) for t in tokens] == [text[a:z] for _, (a, z) in cut.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_token_counts(spark, cut):
    texts = [None, "", "<|endoftext|>", " ", "x" * 5000, *odd_texts(60, 7)]
    rows = [(i % 50 if i else None, t, "t", i) for i, t in enumerate([*texts, *texts[:9]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string, row long").repartition(3)
    want = Counter((r[0], len((r[1] or "").encode()), (n := len(cut.tokenizer.encode(r[1] or "", add_special_tokens=False).ids)), n > 20) for r in rows)
    for share in (1_000_000, 3):  # all known in the tasks, or met by the join
        got = tokencounts.count_tokens(docs, limit=20, share=share)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(map(tuple, got.collect())) == want
    assert tokencounts.count_tokens(docs.limit(0)).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(((-words[v], v) for v in vs), default=None) for w, vs in near.items()}
    form = {w: b[1] if b and -b[0] >= ratio * words[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


@pytest.mark.parametrize("block", [2, 7, 10_000])
def test_variants(spark, block):
    r = random.Random(block)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))): r.choice([1, 1, 2, 5, 20, 300, 4000]) for _ in range(500)}
    words |= {"z" * 3000: 2, "z" * 3001: 50, "z" * 1500 + "y" + "z" * 1499: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, ratio=4, block=block)
    assert set(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(words, 4)
    assert spelling.variants(df.limit(0)).count() == 0


def test_words_of_texts(spark):
    texts = [None, "", "Überraschung überall; UBERALL-uberall ×÷ 7 Zwanzig", "Zwanzig zwanzig " * 40, "Straße Straße Straßenbahn " * 20]
    docs = spark.createDataFrame([(None if i == 2 else i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    want = Counter()
    for i, t in enumerate(texts):
        for run in spelling_runs(t or ""):
            h = zlib.crc32(f"{'' if i == 2 else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    got = spelling.word_counts(spelling.with_slips(spelling.runs(docs), 3), min_chars=7, min_count=1)
    assert dict(map(tuple, got.collect())) == {w: n for w, n in want.items() if len(w) >= 7}


def spelling_runs(text):
    import re

    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[A-Za-zÀ-ÿ]+", text)]


def brute_nodes(rows):
    """rows: conv_id, turn, role, text without ties."""
    own = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1])):
        own[c].append((role or "", text or ""))
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    out = {}
    for s, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == s)))
        out[s] = [min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), kids[s], 0, 0, hashlib.sha256(ends.encode()).hexdigest()]
    for s in members:
        for d in range(len(s) + 1):
            out[s[:d]][5] += kids[s] == 0
            out[s[:d]][6] += (out[s][3] - 1) * (len(s[-1][1]) if s else 0)
    return Counter(map(tuple, out.values()))


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(0, n):
        kind = r.randint(0, 4)  # a third begin alike, some are the same throughout
        for t in range(r.choice([1, 2, 3, 8, 30])):
            text = f"hello {t}" if kind < 2 or (kind == 2 and t < 3) else r.choice(["x", "yy", "é漢😀", None, ""]) if t < 6 else f"{c}-{t}"
            rows.append((c, None if t == 0 and kind == 4 else t, None if t == 1 else "user" if t % 2 == 0 else "assistant", text))
    return rows


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("heavy,shard", [(10_000, 20_000), (20, 30), (1, 1)])
def test_prefix_trie(spark, heavy, shard):
    rows = conversations(heavy, 230)
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    trie = prefixtrie.Trie(prefixtrie.prefixes(prefixtrie.rebuilt(prefixtrie.turns(df))), heavy, shard)
    none = hashlib.sha256().hexdigest()
    got = trie.nodes().join(trie.ends(), ["a", "b"], "left").fillna({"ends_sha256": none}).select(*COLS)
    assert Counter(map(tuple, got.collect())) == brute_nodes(rows)
    # the stored tries answer look-ups by label
    nodes = {(x["a"], x["b"]): x for x in trie.nodes().collect()}
    stored = trie.tries().collect()
    assert sum(x["n_nodes"] for x in stored) + trie.upper.count() == len(nodes)
    for x in stored:
        bits = np.unpackbits(np.frombuffer(x["louds"], dtype=np.uint8))[: 2 * x["n_nodes"] + 1].astype(bool)
        parent = prefixtrie.Louds.parents(bits)
        for k in range(x["n_nodes"]):
            node = nodes[x["a"][k], x["b"][k]]
            assert prefixtrie.child(bits, np.array(x["label"]), int(parent[k]), x["label"][k]) is not None
            if parent[k]:
                assert (node["pa"], node["pb"]) == (x["a"][parent[k] - 1], x["b"][parent[k] - 1])
                assert prefixtrie.child(bits, np.array(x["label"]), int(parent[k]), x["label"][k]) == k + 1
    assert prefixtrie.Trie(prefixtrie.prefixes(prefixtrie.rebuilt(prefixtrie.turns(df.limit(0))))).nodes().count() == 0


def test_conversations_without_ids_or_turns_of_their_own(spark):
    rows = [(None, 0, "user", "a"), *((c, t, "user", f"{c % 2}{t}") for c in range(100, 140) for t in range(c % 3 + 1)), (7, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trie = prefixtrie.Trie(prefixtrie.prefixes(prefixtrie.rebuilt(prefixtrie.turns(df))), 3, 5)
    got = trie.nodes().join(trie.ends(), ["a", "b"], "left").fillna({"ends_sha256": hashlib.sha256().hexdigest()}).select(*COLS)
    assert Counter(map(tuple, got.collect())) == brute_nodes(rows[1:])


def test_a_hash_of_many_pieces(spark, monkeypatch):
    ids = list(range(-3, 30_000, 2))
    rows = [(c, 0, "user", "the same") for c in ids]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    own = prefixtrie.turns(df)
    marked = own.selectExpr("conv_id", "-1 part", "0L i", "0L label", "0L other", "0L chars").unionByName(own.selectExpr("conv_id", "1 part", "i", "label", "other", "chars"))
    got = {x["ends_sha256"] for x in prefixtrie.Trie(prefixtrie.prefixes(marked)).ends().collect()}
    assert got == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}
