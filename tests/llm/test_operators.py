"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and
columns whose names clash with results."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from wordloom.llm import chat, common, decontaminate, graph, linededup, maxent, packing, registry, sharding, simhash, syncmers, toxicity, urlfilter, wordhash

RNG = random.Random(7)
WORDS = ["ab", "cd", "The", "fox", "über", "x,", "Qu", "lazy.", "dog", "ÉTÉ", "n1", "it's"]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = [sentence(60) for _ in range(6)]
LINE = "  Shared LINE of text\t"
TEXTS = (
    [None, "", " \n\t ", "one", "Two words", "ümlaut ß Ünï", "a\n\nb\n" + LINE, "<|endoftext|> <turn> </turn>", "x" * 5000, sentence(9000)]
    + BASE
    + [BASE[0]] * 4
    + [BASE[1] + " extra", BASE[1].replace("fox", "cat", 1)]
    + [f"{sentence(4)}\n{LINE.strip().lower() if i % 2 else LINE}\n{sentence(3)}" for i in range(12)]
)
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "another text"), (None, "no id"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # names that clash with what operators add
    data = [(i, t, "en", "s", len(t or ""), 5, 6, "k") for i, t in ROWS]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def query_on(spark, tmp_path, name, **tables):
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    return registry.QUERIES[name](spark, str(tmp_path))


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# --- words ------------------------------------------------------------------------------------------------


def test_word_batches():
    texts = [None if t is None else t.encode() for _, t in ROWS] + [b"", b" ", b"a" * 3_000_000 + b" b"]
    b = wordhash.Batch(texts)
    words = [w for t in texts for w in (t or b"").lower().split()]
    assert b.words(np.arange(len(b.begin))) == words
    assert b.count.tolist() == [len((t or b"").split()) for t in texts]
    by_word = defaultdict(set)
    for w, h in zip(words, b.hash.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({h for hs in by_word.values() for h in hs}) == len(by_word)
    t = wordhash.Table(8)
    keys = np.unique(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000))
    for i in range(0, len(keys), 700):
        t.put(keys[i : i + 700], np.arange(len(keys))[i : i + 700])
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + 1) < 0).mean() > 0.99


# --- 1 ----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    own = list(range(len(fps)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                own[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, docs, empty, tmp_path):
    got = query_on(spark, tmp_path, "op1_simhash_near_dedup", documents=docs)
    fps = [brute_fingerprint(t) for _, t in ROWS]
    roots = brute_components(fps)
    name = defaultdict(list)
    for (i, _), r in zip(ROWS, roots, strict=True):
        name[r] += [i] if i is not None else []
    want = Counter((i, f"{f:016x}", min(name[r], default=None)) for (i, _), f, r in zip(ROWS, fps, roots, strict=True))
    assert bag(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))
    assert simhash.keep_one(empty).count() == 0


def test_links_in_split_shards(spark):
    # clusters of close fingerprints, more than fit one part of a shard
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 20, rng.integers(1, 6)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = graph.components(simhash.link(df, shard_size=16))
    label = {r["v"] % (1 << 64): r["label"] for r in found.collect()}
    roots = brute_components(fps)
    groups, mine = defaultdict(set), defaultdict(set)
    for f, r in zip(fps, roots, strict=True):
        groups[r].add(f)
        mine[label.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    with pytest.raises(ValueError):
        simhash.link(df, radius=5, blocks=5)


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    label = {r["v"]: r["label"] for r in graph.components(links).collect()}
    assert len({label[i] for i in range(n + 1)}) == 1 and label[1000] == label[1001] != label[0]
    assert graph.components(links.limit(0)).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------------


def test_lm(spark, docs, empty, tmp_path):
    got = query_on(spark, tmp_path, "op2_lm_scoring", documents=docs).collect()
    train = [t for i, t in ROWS if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in [*(t or "").encode().lower().split(), 0])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in ROWS:
        ws = [*(t or "").encode().lower().split(), 0]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    model = maxent.train(empty)
    assert (model.n, model.v) == (0, 0)
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in maxent.score(docs, model).collect())
    assert maxent.score(empty, model).count() == 0


def test_lm_with_rare_words_joined(spark, docs, monkeypatch):
    model = maxent.train(docs)
    a = {(r["doc_id"], r["n_tokens"]): (r["n_known"], r["base_score"], r["score"]) for r in maxent.score(docs, model).collect()}
    monkeypatch.setattr(maxent, "FREQUENT", 20)  # most words go through the join now
    b = {(r["doc_id"], r["n_tokens"]): (r["n_known"], r["base_score"], r["score"]) for r in maxent.score(docs, model).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_lm_is_a_distribution():
    """Class probabilities of any history sum to one, and so do the words of a class."""
    rng = np.random.default_rng(1)
    w = rng.normal(size=(maxent.ROWS + 1, maxent.CLASSES)).astype(np.float32)
    _, e, total = maxent.softmax(w, rng.integers(0, maxent.ROWS, (50, 5)))
    assert np.allclose((e / total[:, None]).sum(1), 1, atol=1e-5)
    counts = rng.integers(1, 50, 30)
    assert ((counts + 0.1) / (counts.sum() + 0.1 * 31)).sum() + 0.1 / (counts.sum() + 0.1 * 31) == pytest.approx(1)


@pytest.mark.parametrize("rounds", [1, maxent.ROUNDS, 3])
def test_lm_trains_on_every_position(rounds):
    texts = [t.encode() for t in TEXTS if t is not None] + [b"lone", b"two words"]
    bucket_class = np.arange(maxent.BUCKETS + 1) % maxent.CLASSES
    start = np.zeros((maxent.ROWS + 1, maxent.CLASSES), dtype=np.float32)
    hashes, buckets, begins = maxent.read(texts)
    want = set(maxent.features(hashes, bucket_class[buckets], begins).ravel().tolist()) | {maxent.ROWS}
    for size in (1, 7, len(texts)):  # however the texts fall into batches
        batches = [pa.record_batch([pa.array(texts[i : i + size], pa.binary())], names=["text"]) for i in range(0, len(texts), size)]
        got = set()
        for turn in range(rounds):
            for b in maxent._train(iter(batches), start, bucket_class, turn, rounds):
                for block, tasks in zip(b.column("block").to_pylist(), b.column("tasks").to_pylist(), strict=True):
                    got |= set((block * maxent.BLOCK + np.flatnonzero(np.frombuffer(tasks, dtype=np.float32))).tolist())
        assert got == want


def test_lm_beats_unigrams_on_held_out_rows(spark):
    r = maxent.op2_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert r["s"] > r["b"] + 0.2


# --- 3 ----------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, empty, tmp_path):
    got = query_on(spark, tmp_path, "op3_sharding", documents=docs).toPandas()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((None if pd.isna(i) else i, s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby("doc_id").shard.nunique().max() == 1
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 8)).all()
    assert sharding.shard(empty, {0: 1.0, 1: 1.0}).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs, {0: 0.0})


def test_weights_and_growth(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    out = sharding.shard(df, {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0, 2: 4.0}).toPandas()
    assert (out.shard == 1).mean() == pytest.approx(0.75, abs=0.02)
    assert (out.grown_shard == 2).mean() == pytest.approx(0.5, abs=0.02)
    assert ((out.grown_shard == 2) | (out.grown_shard == out.shard)).all()


def test_a_third_of_the_rows_alike(spark):
    df = spark.range(3000).selectExpr("if(id < 1000, 7, id) AS doc_id", "'t' AS text")
    out = sharding.shard(df, {0: 1.0, 1: 1.0}).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard")) and len(out) == 3000


# --- 4 ----------------------------------------------------------------------------------------------------


def test_packing(spark, docs, empty, tmp_path):
    got = query_on(spark, tmp_path, "op4_packing", documents=docs).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[i, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)] += 1
    assert Counter((None if pd.isna(r.doc_id) else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    assert packing.pack(empty).count() == 0
    with_ids = packing.pieces_of(docs, with_ids=True).first()
    assert zlib.crc32(np.array(with_ids["ids"], dtype="<u4").tobytes()) == with_ids["ids_crc32"]


def test_encoder_is_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path, most=50)
    hard = ["it's IT'S 's x's, don't!!", "ﬁ e\u0301 É ß İ Σς", "a\u00a0b\u2028c\u3000d", "<|endoftext|>x <|ENDOFTEXT|> <|", "12.5 a1b2 ... ,,x", "\x1c\x85a", "日本語 テスト", "Straße,und«x»", "", "\u0301a b"]
    for _ in range(3):
        got = enc([t.encode() for t in hard])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in hard]


@pytest.mark.parametrize("seed", range(5))
def test_shortest_pack_first(seed):
    rng = np.random.default_rng(seed)
    h = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 4000).astype(int) + 1).tolist())
    plan = packing.shortest_pack_first(dict(h))
    placed = Counter()
    for c, p in plan:
        assert sum(n * k for n, k in p) <= 4096
        for n, k in p:
            placed[n] += c * k
    assert placed == h and len(plan) <= 2 * len(h) + 2
    assert sum(c for c, _ in plan) <= sum(n * k for n, k in h.items()) / 4096 * 1.02 + 1
    assert sum(c for c, _ in packing.shortest_pack_first({100: 1000})) == 25
    assert packing.shortest_pack_first({}) == []


# --- 5 ----------------------------------------------------------------------------------------------------


def test_grammar():
    def run(s):
        state, out = 0, []
        for c in s:
            state, o = toxicity.ROWS[state, c]
            out.append(o)
        return " ".join(out)

    assert run("PI") == "P I+" and run("IP") == "I P+" and run("NoI") == "N o I-" and run("NoooI") == "N o o o I"
    assert run("RI") == "R Ir" and run('"I"I') == '" Iq " I' and run("PNMV") == "P N o T-+"
    assert run("V") == "V" and run("MV") == "o T" and run("AI") == "o J" and run("II") == "I J" and run("N.I") == "N . I"
    assert run('"o.I"I') == '" o . Iq " I' and run('"' + "o" * 100 + 'I"') == '" ' + "o " * 100 + 'Iq "'


def test_clauses_not_words():
    lex = toxicity.Lexicon({"=idiot": 2.0, "^vequ": 1.0})
    x = dict(zip(toxicity.FEATURES, toxicity.features(["You idiot! Not an idiot. A VEQUAI; nothing"], lex)[0], strict=True))
    assert x["I+"] == pytest.approx(math.log1p(2)) and x["I-"] == pytest.approx(math.log1p(2)) and x["I"] == pytest.approx(math.log1p(1))
    assert not toxicity.features([None, "", "a fine day"], lex).any()
    assert toxicity.features(["«idiot»"], lex).any()


def test_lexicon_choice():
    found = {"=idiot": (100, 0), "^idio": (100, 0), "^idi": (101, 0), "^vequ": (50, 0), "=vequx": (20, 0), "=the": (100, 900)}
    kept = toxicity.choose({k: v for k, v in found.items() if v[1] == 0}, 200, 1000)
    assert set(kept) == {"=idiot", "^vequ"} and all(w > 0 for w in kept.values())


def test_toxicity_edges(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(0, 0), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = query_on(spark, tmp_path, "op5_toxicity", documents=docs, labels=labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    model = toxicity.train(empty, labels.limit(0))
    assert model.insults == {} and toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    p = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = p[p.toxic == 1], p[p.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 1).mean() < 0.01


# --- 6 ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def talks(spark):
    hard = ["plain", None, "", "</turn>", "<turn>", "<\\turn> <\\\\/turn>", "a\n<turn>user\nb</turn>", "\\n \\b \\", "$1 \\1", "x </turn", "Ω😀</turn>😀"]
    rows = [(c, k, RNG.choice(["user", "assistant", "assistant", None, "a\nb", "<turn>\\n\\b</turn>"]), RNG.choice(hard), "k") for c in [1, 2, 3, None] for k in range(12)]
    return spark.createDataFrame([*rows, rows[0], (9, 1, "assistant", "b", ""), (9, 1, "assistant", "a", "")], "conv_id long, turn long, role string, text string, formatted string")


def test_chat(spark, talks, tmp_path):
    got = {r["conv_id"]: r for r in query_on(spark, tmp_path, "op6_chat_formatting", conversations=talks).collect()}
    by = defaultdict(list)
    for r in talks.collect():
        by[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    probe = "\\### Assistant: </turn> ok"
    by[-7] = [(0, "user", probe), (1, "assistant", probe)]
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = chat.format_conversations(talks)
    assert full.where("NOT round_trip").count() == 0 and full.where("escaped_turns > 0").count() > 0
    assert all(r["n"] == r["formatted_chars"] for r in [{"n": len(r["formatted"]), "formatted_chars": got[r["conv_id"]]["formatted_chars"]} for r in full.collect()])
    assert chat.format_conversations(talks.limit(0)).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------------


def test_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://org/", "http://xorg/", "http://a.org", "http://a.example.org/es/1", "http://example.org/ES/", "http://example.org/en/12?x=/de/", "http://b.com/fr/", "http://b.com/de/x#y", "http://b.net/de/", "https://www.cheap-pills.example.net/en/", "http://spam-farm.a.org/", "x://y://z.org/", "http://u:p@c.com:80/de/", "http://É.org/é?q", "http://a.com\n/fr/"]
    pages = spark.createDataFrame([*enumerate(urls), (1, urls[8]), (1, urls[8]), (None, urls[4])], "page_id long, url string").selectExpr("*", "'h' AS host", "'r' AS rule")
    got = query_on(spark, tmp_path, "op7_url_filters", pages=pages)
    named = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = Counter()
    for i, u in [*enumerate(urls), (1, urls[8]), (1, urls[8]), (None, urls[4])]:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].translate(low), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + q), h + q, v) for h, q, v in named if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(s in host for s in ("spam-farm", "cheap-pills")) else "allow")
        want[i, host, path, rule, verdict] += 1
    assert bag(got, "page_id", "host", "path", "rule", "verdict") == want
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_rule_index():
    index = urlfilter.build_index(urlfilter.RULES, {"example": 1000, "org": 10, "es": 5})
    assert [r.name for r in index["es"]] == ["example.org/es/"] and sum(map(len, index.values())) == len(urlfilter.RULES)
    assert urlfilter.build_index([urlfilter.Rule("block", ".*", ())], {}) == {"": [urlfilter.Rule("block", ".*", ())]}


# --- 8 ----------------------------------------------------------------------------------------------------


def brute_overlaps(texts, items):
    def words(t):
        out, w = [], ""
        for c in (t or "") + " ":
            if c.isdigit() and c.isascii() or c.isalpha() and c.isascii() or ord(c) > 127:
                w += c.lower() if c.isascii() else c
            elif w:
                out.append(w)
                w = ""
        return out

    windows = defaultdict(set)
    for k, t in items:
        ws = words(t)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[i : i + 10])].add("null" if k is None else str(k))
    sizes = {len(w) for w in windows}
    for t in texts:
        ws = words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (own := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        yield len(ws), len(hit), found


@pytest.mark.parametrize("block_words", [2_000_000, 25])
def test_decontamination(spark, docs, empty, tmp_path, block_words):
    items = [(1, BASE[2]), (2, " ".join(BASE[3].split()[5:20])), (3, "Two, words"), (4, None), (5, ""), (10, BASE[2]), (1, "one"), (None, BASE[4]), (6, "unseen " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = list(zip(ROWS, brute_overlaps([t for _, t in ROWS], items), strict=True))
    want = Counter((i, n, h, ",".join(sorted(f))) for (i, _), (n, h, f) in rows)
    found = decontaminate.find_overlaps(docs, bench, block_words=block_words)
    got = Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(r["items"])) for r in found.collect())
    assert got == want
    if block_words > 100:
        q = query_on(spark, tmp_path, "op8_benchmark_decontamination", documents=docs, benchmark=bench)
        assert bag(q, "doc_id", "n_hit", "n_items", "items_sha256", "contaminated") == Counter((i, h, len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), h > 0) for (i, _), (n, h, f) in rows)
    assert decontaminate.find_overlaps(empty, bench).count() == 0
    assert decontaminate.find_overlaps(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not h for _, (_, h, _) in rows)


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 60)), 0) for _ in range(30)])
    text = np.concatenate((text, text[:200], [0]))
    order = decontaminate.suffix_array(text)
    stops = np.flatnonzero(text == 0)
    key = text.astype(int) + len(stops)
    key[stops] = np.arange(len(stops))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: key[i:].tolist())
    index = decontaminate.FMIndex(text, 5)
    for n in (1, 3, 7):
        pats = rng.integers(1, 6, (40, n))
        low, high = index.search(pats)
        for p, a, z in zip(pats, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, z)).tolist() if a < z else []) == want


def test_cut_spans():
    assert decontaminate.cut_spans("One, two! Three four.", [(1, 3)]) == "One,  four."
    assert decontaminate.cut_spans(None, []) is None and decontaminate.cut_spans("a", []) == "a"


# --- 9 ----------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty, tmp_path):
    got = query_on(spark, tmp_path, "op9_document_fingerprints", documents=docs).collect()
    ids = [i for i, _ in ROWS if i is not None and i != 3]
    by = {r["doc_id"]: r for r in got if r["doc_id"] in set(ids)}
    text = dict(ROWS)
    for i in [k for k in ids if k not in (0, 4)]:  # those whose next row is certain
        t, nxt = text[i] or "", text[i - 1] or ""
        c = len(t) // 3
        edited = t[: len(t) - c] + nxt[:c]
        assert by[i]["n_chars"] == len(t) and by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len(got) == len(ROWS) and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    same = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            same[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(f) == 1 for f in same.values()) and len(same[BASE[0]]) == 1
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == ""
    assert syncmers.next_text(empty, ["text"]).count() == 0
    one = docs.where("doc_id = 12")
    assert syncmers.next_text(one, ["text"]).first()["next_text"] == BASE[2]


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_next_row_over_buckets(spark, bucket_rows):
    ids = RNG.sample(range(-500, 10_000), 157) + [77777, 77777, None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["next_text"]) for r in syncmers.next_text(df, ["text"], bucket_rows=bucket_rows).collect()]
    order = sorted([i for i in ids if i is not None], reverse=True) + [None]
    assert Counter(got) == Counter((a, f"t{b}") for a, b in zip(order, order[1:] + order[:1], strict=True))


def test_syncmers_are_context_free(spark):
    body = sentence(80)
    df = spark.createDataFrame([(1, body), (2, "some other words first " + body + " and after")], "doc_id long, text string")
    a = syncmers.anchors(df)
    m = syncmers.positional_matches(a.where("doc_id = 1"), a.where("doc_id = 2")).orderBy("n", ascending=False).first()
    n = a.where("doc_id = 1").count()
    assert m["n"] >= n - 2 and m["displacement"] > 0


# --- 10 ---------------------------------------------------------------------------------------------------


def brute_lines(rows, min_docs, later):
    blank = "\t\n\x0b\x0c\r "
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    at = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    for n, (i, lines) in enumerate(split):
        for p, line in enumerate(lines):
            if k := line.strip(blank).translate(low):
                at[k].add((i is not None, i or 0, n, p) if later else (i is not None, i or 0))
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(at.get(x.strip(blank).translate(low), ())) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, docs, empty, tmp_path):
    got = query_on(spark, tmp_path, "op10_line_dedup", documents=docs)
    assert bag(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(ROWS, 10, False)
    left = linededup.drop_lines(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect() if r["text"] is not None)
    assert linededup.drop_lines(empty).count() == 0


@pytest.mark.parametrize(("n_batches", "seed"), [(1, 0), (3, 1), (40, 2), (200, 3)])
@pytest.mark.parametrize("parts", [1, 2, 5])
@pytest.mark.parametrize("later", [False, True])
def test_streamed_runs(n_batches, seed, parts, later):
    """Whatever the batches and partitions, the rows of a hash in enough documents are found."""
    rng = np.random.default_rng(seed)
    n = 400
    t = pd.DataFrame({"a": rng.choice([1, 2, 3, 5, 8, 13], n, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]), "b": rng.integers(0, 2, n), "doc": rng.integers(0, 30, n), "body": 0, "pos": 0}).sort_values(["a", "b", "doc"], ignore_index=True)
    t["pos"] = np.arange(n)
    import pyarrow as pa

    groups = t.groupby(["a", "b", "doc"]).ngroup()
    cuts = [0, *sorted(rng.choice(groups.max(), parts - 1, replace=False) + 1), groups.max() + 1]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = t[(groups >= lo) & (groups < hi)]
        table = pa.Table.from_pandas(part.astype({"pos": "int32"}), preserve_index=False)
        step = max(1, len(part) // n_batches)
        batches = [table.slice(i, step).combine_chunks().to_batches()[0] for i in range(0, len(part), step)]
        out += [b.to_pandas() for b in linededup.stream_runs(iter(batches), 8, later)]
    out = pd.concat(out)
    totals = out[out.state == linededup.COUNT].groupby(["a", "b"]).docs.sum()
    hot = {k for k, v in totals.items() if v >= 8}
    docs = t.groupby(["a", "b"]).doc.nunique()
    first = t.groupby(["a", "b"]).pos.min()
    want = {r.pos for r in t.itertuples() if docs[r.a, r.b] >= 8 and not (later and first[r.a, r.b] == r.pos)}
    sure = set(out[out.state == linededup.DROP].pos.astype(int))
    loose = out[out.state == linededup.OPEN]
    loose = loose[[(a, b) in hot for a, b in zip(loose.a, loose.b, strict=True)]] if len(loose) else loose
    begun = {(a, b) for a, b in zip(out[out.state == linededup.DROP].a, out[out.state == linededup.DROP].b, strict=True)}
    got = set(sure)
    for k, g in loose.groupby(["a", "b"]):
        ps = set(g.pos.astype(int))
        got |= ps - ({min(ps)} if later and k not in begun else set())
    assert got == want


def test_later_lines(spark):
    df = spark.createDataFrame([(i, f"same\nown {i}\n SAME") for i in range(12)] + [(50, "same")], "doc_id long, text string").repartition(4)
    left = {r["doc_id"]: r["text"] for r in linededup.drop_lines(df, min_docs=10, mode="later").collect()}
    assert left[0] == "same\nown 0" and left[5] == "own 5" and left[50] == ""
    with pytest.raises(ValueError):
        linededup.dropped_lines(df, mode="other")


# --- all --------------------------------------------------------------------------------------------------


def test_shared_folder(spark, tmp_path):
    """The session's setting is used; where there is none, a folder of our own."""

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: str(tmp_path))})

    assert common.shared_dir(Session()) == str(tmp_path)
    assert common.shared_dir(spark) and common.written(spark.range(3), "x").count() == 3


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    json.dumps(entry.oracle_sql())


def test_random_unicode_is_the_tokenizer_s():
    """Words that change when lower-cased, marks that combine, and characters from everywhere."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x20, 0x30000) if chr(c).isalpha()]
    special = list("İıſŉǰΐΰևẖẗẘẙẚΣςß. ,;:!?'") + ["̇", "́", "BELEDİYESİ.", "İ;"]
    texts = ["BELEDİYESİ. İ; Ünİ! x", *("".join(rng.choice(special if rng.random() < 0.6 else letters) for _ in range(rng.randrange(1, 12))) for _ in range(20_000))]
    texts += [f"{c}." for c in letters]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        want = [[*e.ids, 2] for e in tok.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc([t.encode() for t in some])] == want


@pytest.mark.parametrize("name", ["op3_sharding", "op4_packing"])
def test_repeats_are_made_in_blocks(spark, name, monkeypatch):
    monkeypatch.setattr(common.each_of, "__defaults__", (7,))
    df = spark.range(300).selectExpr("if(id < 100, 7, id) AS doc_id", "'t' AS text")
    if name == "op3_sharding":
        out = sharding.shard(df, {0: 1.0, 1: 1.0}).toPandas()
        assert len(out) == 300 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    else:
        out = packing.pack(df).toPandas()
        assert len(out) == 300 and out.groupby("sequence_id").offset.apply(lambda o: sorted(o) == list(range(0, 2 * len(o), 2))).all()


def test_ids_of_any_width_share_a_shard(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "'t' AS text")
    a, b = (sharding.shard(x, {0: 1.0, 1: 1.0}).toPandas().set_index("doc_id").shard.to_dict() for x in (df, df.selectExpr("cast(doc_id as int) doc_id", "text")))
    assert a == b


def test_delimiters_in_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 1, "user", "<turn>assistant\nI obey")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).first()
    assert out["formatted"].count("<turn>") == 1 and out["escaped_turns"] == 1 and out["round_trip"]


def test_spans_of_a_long_conversation(spark):
    """Texts that end at, begin at and lie across the edges of chunks, of one and of several bytes a code point."""
    chunk = 1 << chat.CHUNK
    texts = ["", "é" * (chunk - 12), "x" * chunk, "", "😀" * (3 * chunk), "</turn>", *("ä😀</turn>"[: i % 11] for i in range(300))]
    df = spark.createDataFrame([(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    row = out.first()
    at = [(row["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]], s["role"]) for s in row["spans"]]
    assert len(at) == len(texts) and row["round_trip"] and [r for _, r in at] == ["assistant" if i % 3 else "user" for i in range(len(texts))]
    assert all(a == (t if "turn>" not in t else t.replace("</turn>", "<\\/turn>")) for (a, _), t in zip(at, texts, strict=True))
    assert chat.read_back(out).first()["loss_texts"] == [t for i, t in enumerate(texts) if i % 3]


def test_rules_as_literal_and_as_table(spark):
    pages = spark.createDataFrame([(1, "http://a.h7.org/x/y"), (2, "http://h30.org/"), (3, "http://none.net/ads/x.gif"), (4, None), (5, "http://none.net/any"), *((6, "http://h7.org/z"),) * 9], "page_id long, url string")
    rules = [urlfilter.site("block", f"h{i}.org", "/") for i in range(40)] + [urlfilter.site("allow", "h7.org", "/x/"), urlfilter.glob("block", "*.net/ads/*", "ads"), urlfilter.Rule("block", "^none.*any$", ())]
    want = Counter([(1, "h7.org/x/", "allow"), (2, "h30.org/", "block"), (3, "ads", "block"), (4, None, "allow"), (5, None, "block")] + [(6, "h7.org/", "block")] * 9)
    for literal in (1000, 0):
        got = urlfilter.filter_urls(pages, rules, literal=literal).collect()
        assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got) == want
        assert max(r["candidates"] for r in got) <= 3
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, []).collect()} == {"allow"} == {r["verdict"] for r in urlfilter.filter_urls(pages, [], literal=-1).collect()}
    assert urlfilter.filter_urls(pages.limit(0), rules, literal=0).count() == 0


def test_many_rules(spark, sf):
    """100,000 rules over every page: the verdicts are those of the few rules that can fit."""
    import time

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    many = [urlfilter.site("block", f"site{i}.example{i % 77}.net", f"/p{i % 13}/") for i in range(100_000)]
    begin = time.perf_counter()
    got = urlfilter.filter_urls(pages, [*many, *urlfilter.RULES]).select("page_id", "rule", "verdict").collect()
    assert time.perf_counter() - begin < 90
    assert Counter(map(tuple, got)) == Counter(map(tuple, urlfilter.filter_urls(pages).select("page_id", "rule", "verdict").collect()))


def test_hot_keys_join(spark):
    rows = spark.range(3000).selectExpr("if(id < 1000, 7, id) AS k", "id")
    side = rows.groupBy("k").agg({"id": "count"}).withColumnRenamed("count(id)", "n")
    got = common.join_hot(rows, side, "k", "n", 3000)
    assert got.count() == 3000 and got.where("n = 1000").count() == 1000


def test_size_settings_are_read_as_spark_writes_them(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for size, want in (("64m", str(8 << 20)), ("1m", "1m")):
        spark.conf.set(key, size)
        common.small_batches(spark)
        assert spark.conf.get(key) == want


def test_quotes_reach_to_their_end_and_negation_counts():
    lex = toxicity.Lexicon({"=idiot": 2.0})

    def x(text):
        return dict(zip(toxicity.FEATURES, toxicity.features([text], lex)[0], strict=True))

    assert x('He said: "First. You idiot."')["Iq+"] > 0 and x('He said: "First. You idiot."')["insults"] == 0
    assert x('an inch is 1". You idiot')["I+"] > 0  # a mark without a partner
    assert x('"a" "b. c\nd idiot" idiot')["Iq"] == x('"a" "b. c\nd idiot" idiot')["I"]
    assert x("he is an idiot")["insults"] > 0 == x("he is not an idiot")["insults"]
    assert x("i will kill you")["threats"] > 0 == x("they kill time")["threats"]


def brute_patterns(text, lexicon):
    """All words of all clauses, none skipped, through the composed machine itself instead of its table."""
    text = toxicity.parted(text.lower())
    quotes, seen, state, sums = text.count('"'), 0, toxicity.GRAMMAR.start, Counter()
    for clause in toxicity._CLAUSE.split(text):
        for w in [*clause.translate(toxicity._APART).split(), None]:
            c, weight = (".", 1.0) if w is None else lexicon(w)
            if c == '"':
                seen += 1
                c = '"' if seen <= quotes - quotes % 2 else "o"
            state, out = toxicity.GRAMMAR.step(state, c)
            if out[0] in toxicity.MEANT or out == "P+":
                sums[out] += weight if c == "I" else 1.0
    return [math.log1p(sums[p]) for p in toxicity.PATTERNS]


def test_toxicity_scores_by_brute_force(spark):
    rng, lex = random.Random(9), {"=idiot": 2.0, "^moro": 1.5}
    words = 'you not said idiot moron kill will such a the . ! " “ … \n — , he never'.split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    model = toxicity.Model(lex, np.linspace(-1, 1, len(toxicity.FEATURES) + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    lexicon = toxicity.Lexicon(lex)
    for i, t in enumerate(texts):
        p = dict(zip(toxicity.PATTERNS, brute_patterns(t, lexicon), strict=True))
        plain = {k: math.expm1(v) for k, v in p.items() if k in toxicity.PLAIN}
        insults, threats = sum(v for k, v in plain.items() if k[0] in "IJ"), sum(v for k, v in plain.items() if k[0] == "T")
        n = len(toxicity.words_for_screening(t.lower()).split())
        x = [1, math.log1p(insults), math.log1p(threats), 100 * insults / (100 + n), *p.values()]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, model.weights)))), abs=1e-9)


def test_lm_score_by_brute_force(spark):
    """Token by token, from the model's tables and the definition; and the words of a history sum to one."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "tri", "no", "za") for b in ("ma", "lu", "ter", "x", "en", "os")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = maxent.train(df.where("doc_id < 50"))
    assert np.abs(model.nodes.weights).max() > 0
    counts = {r["k"]: r["n"] for r in model.counts.collect()}

    def chance(word, bucket, history):
        """log10 of P(word | history); history: (word, class) pairs, the last one first."""
        cls = int(model.bucket_class[bucket])
        w = [h for h, _ in history] + [7] * 4
        c = [k for _, k in history] + [maxent.CLASSES] * 4
        u = 1 << 64
        keys = [w[0] * 3 % u, (w[1] * 5 + 1) % u, (w[0] * 31 % u) ^ (w[1] * 17 % u), (c[0] * 64 + c[1]) * 64 + c[2] + (1 << 40), c[1] * 64 + c[3] + (1 << 41)]
        mix = int(maxent._MIX)
        rows = [((k ^ k >> 29) * mix % u) >> 64 - 15 for k in keys]
        z = sum(model.weights[r].astype(float) for r in rows) + model.weights[-1]
        log = z[cls] - math.log(np.exp(z).sum())
        leaf = word % 32
        if cls != maxent.END_CLASS:
            for d in range(5):
                node, side = (1 << d) - 1 + (leaf >> 5 - d), leaf >> 4 - d & 1
                left, right = (sum(model.mass[cls][i] for i in range(32) if i >> 5 - d == leaf >> 5 - d and (i >> 4 - d & 1) == s) for s in (0, 1))
                x = math.log(right / left)
                for k in keys[:3]:
                    own = ((k ^ k >> 29) * mix % u) ^ ((cls * 64 + node + 1) * 0xD6E8FEB86659FD93 % u)
                    x += float(model.nodes.weights[(own * mix % u) >> 64 - 18])
                log += -math.log1p(math.exp(-x if side else x))
        signed = word - u if word >> 63 else word
        return log / math.log(10) + math.log10((counts.get(signed, 0) + 0.1) / model.mass[cls][leaf])

    got = {r["doc_id"]: r["score"] for r in maxent.score(df, model).collect()}
    for i, t in enumerate(texts):
        hashes, buckets, _ = maxent.read([(t or "").encode()])
        history, total = [], 0.0
        for h, b in zip(hashes.tolist(), buckets.tolist(), strict=True):
            total += chance(h % (1 << 64), b, history)
            history.insert(0, (h % (1 << 64), int(model.bucket_class[b])))
        assert got[i] == pytest.approx(total, abs=1e-3)
    # all words, and in every leaf of every class one never seen
    known, place, _ = maxent.read([" ".join(vocabulary).encode()])
    seen = {h % (1 << 64): b for h, b in zip(known.tolist(), place.tolist(), strict=True)}
    history = [(w, int(model.bucket_class[b])) for w, b in list(seen.items())[:4]]
    whole = sum(10 ** chance(w, b, history) for w, b in seen.items() if (w - (1 << 64) if w >> 63 else w) in counts)
    bucket_of = {int(c): b for b, c in enumerate(model.bucket_class)}
    taken = set(seen)
    for c in range(maxent.CLASSES - 1):
        for leaf in range(32):
            if c in bucket_of:
                unknown = next(x for x in range(leaf, 1 << 40, 32) if x not in taken)
                whole += 10 ** chance(unknown, bucket_of[c], history)
    # the end of a text also keeps a place for a word never seen, and classes without a bucket have no words
    empty = [c for c in range(maxent.CLASSES) if c not in bucket_of]
    assert not empty and whole == pytest.approx(1, abs=0.01)
