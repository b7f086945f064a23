"""Prefix trie, importance resampling and byte-level BPE against brute force and the tokenizer's library."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from murmuration.llm import queries


def brute_trie(rows):
    """Nodes by plain dictionaries of prefixes; rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {}
    for c, held in own.items():
        key = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:".encode() + t[2].encode() + t[3].encode()).digest()[:16])
        turns[c] = [(r, x) for _, _, r, x in sorted(held, key=key)]
    built = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def trie_rows(df):
    from murmuration.llm.prefix_trie import conversation_trie

    got = conversation_trie(df).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert trie_rows(df) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    q = queries.op11_conversation_trie(spark, sf)
    assert q.count() == len(brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 20), (3, 40), (4, 150)])
def test_trie_shapes(spark, seed, longest):
    """Deep shared prefixes that end at, before and after strip borders, copies, gaps in ids, turnless conversations, odd rows."""
    rnd, rows = random.Random(seed), []
    trunk = [rnd.choice("ab") for _ in range(longest)]
    for c in rnd.sample(range(-20, 300), 90):
        n = rnd.choice([1, 2, longest // 2, longest, rnd.randint(1, longest)])
        cut = rnd.choice([0, n, rnd.randint(0, n), 16, 32])
        seq = trunk[:cut] + [rnd.choice("abé") for _ in range(max(0, n - cut))]
        rows += [(c, i if rnd.random() < 0.97 else None, rnd.choice(["user", "user", None]) if rnd.random() < 0.1 else "user", t * rnd.choice([1, 1, 1, 3])) for i, t in enumerate(seq[:n])]
        rows += [rows[-1]] * rnd.choice([0, 0, 1])
    rows += [(None, 1, "user", "x"), (7001, 1, None, None), (7001, 1, "", ""), (7003, None, "user", "long" * 100_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as conv", "2 as name", "3 as strip", "4 as depth")
    assert trie_rows(df) == brute_trie(rows)


def test_trie_hot(spark):
    """One conversation with most rows, a large group of copies, one that is absent of its own turns; packs of members are cut."""
    from murmuration.llm import prefix_trie

    rows = [(5, i, "user", str(i % 3)) for i in range(3000)] + [(c, i, "user", "same") for c in range(1000, 1400) for i in range(2)] + [(6, i, "user", str(i % 3)) for i in range(700)]
    was, prefix_trie.PACK_BYTES = prefix_trie.PACK_BYTES, 64
    try:
        assert trie_rows(spark.createDataFrame(rows, CONVERSATIONS)) == brute_trie(rows)
    finally:
        prefix_trie.PACK_BYTES = was


def test_trie_empty(spark):
    assert trie_rows(spark.createDataFrame([], CONVERSATIONS)) == []
    alone = [(c, 0, "user", "x") for c in (1, 2, 3, 4) if zlib.crc32(str(c).encode()) % 9]
    assert alone and trie_rows(spark.createDataFrame(alone, CONVERSATIONS)) == brute_trie(alone)


def brute_resample(documents, target, percent=10, least=20, buckets=10_000, longest=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    here, there = collections.Counter(), collections.Counter()
    for _, text in documents:
        here.update(features(text)[1])
    for text in target:
        there.update(features(text)[1])
    S, T, rows = sum(here.values()), sum(there.values()), []
    for doc_id, text in documents:
        n, found = features(text)
        gains = [math.floor(1000 * math.log((there[b] + 1) * (S + buckets) / ((here[b] + 1) * (T + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return rows


def as_sorted(rows):
    return sorted(tuple(-1 if x is None else x for x in r[:5]) for r in rows)


def test_resample_on_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_sorted(queries.op12_importance_resampling(spark, sf).collect()) == as_sorted(brute_resample(docs, target))


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_odd(spark, longest):
    from murmuration.llm.resample import resample

    rnd = random.Random(4)
    words = ["Aé", "b1", "_", "x", "日本", "{y}", "w" * 100, "\n", "1"]
    docs = [(rnd.choice([i, i, -i, 7]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    docs += [(None, "a b " * 15), (None, "a b " * 15), (9001, None), (9002, ""), (9003, "z " * 50_000), (-(2**63), "p q " * 20), (2**63 - 1, "p q " * 20)] + docs[:5]
    target = ["x b1 日本", None, "", "w" * 100]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as score", "3 as _at", "4 as rank")
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=37, longest=longest)
    assert as_sorted(got.collect()) == as_sorted(brute_resample(docs, target, 37, longest=longest))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0 and resample(df, none).count() == len(docs)


def test_radix_ranks(spark):
    """Keys over all of a long's range, nulls, ties and hot values; more rows than a chunk holds."""
    from murmuration.llm import resample as r

    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 3, 3, 3, rnd.randint(-(2**63), 2**63 - 1), rnd.randint(0, 9)]), rnd.choice([None, -5, rnd.randint(-9, 9)])) for i in range(5000)]
    was, r.CHUNK_BITS = r.CHUNK_BITS, 6
    try:
        df = spark.createDataFrame(rows, "id long, a long, b long").selectExpr("*", "1 as _digit", "2 as n").repartition(5)
        got = sorted((x.rank, x.a, x.b) for x in r.radix_ranks(df, [df.a, df.b]).collect())
    finally:
        r.CHUNK_BITS = was
    order = sorted(((a, b) for _, a, b in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0))
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == order
    same = spark.createDataFrame([(1, 1)] * 7, "id long, a long")
    assert sorted(x.rank for x in r.radix_ranks(same, [same.a]).collect()) == list(range(1, 8))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def test_byte_bpe_table(spark, sf, tokenizer):
    import numpy as np

    from murmuration.llm.byte_bpe import encode_byte_bpe

    odd = [(1, None), (1, None), (None, "x y"), (3, ""), (4, "é" * 5000 + " " * 300), (5, "a<|endoftext|><|endoftext|> b<|endoftext"), (6, "ab" * 100_000), (7, "'LL 'll it's 12½ \x1c\x85　x\n\n y\t\t")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    text = collections.defaultdict(set)
    for r in docs.collect():
        text[r.doc_id].add(r.text or "")
    for r in encode_byte_bpe(docs.selectExpr("*", "1 as ids", "2 as n_tokens"), queries.tokenizer_path("byte_bpe_50k.json")).collect():
        (said,) = text[r.doc_id]
        ids = tokenizer.encode(said, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_byte_bpe(empty, queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe_codec(tokenizer):
    import numpy as np

    from murmuration.llm.byte_bpe import ByteCodec, MergeRules

    rules = MergeRules(queries.tokenizer_path("byte_bpe_50k.json"))
    codec, rnd = ByteCodec(rules), random.Random(6)
    pool = [t.decode("utf-8", "ignore") for t in rules.spelling.values()] + ["\n", "🙂", "\0", "<|endoftext|>", " ", "  ", "\t", "'re", "é" * 7] * 300
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(5000)] + ["a" * k for k in range(60)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for said, coded in zip(texts, codec.encode_run(texts)):
        ids = tokenizer.encode(said, add_special_tokens=False).ids
        assert np.frombuffer(coded, "<u4").tolist() == ids and codec.decode(coded) == tokenizer.decode(ids, skip_special_tokens=False)
    # Every character is split as the library splits it.
    for start in range(0, 0x110000, 0x400):
        said = "".join(f"x{chr(c)}7{chr(c)}%{chr(c)} " for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        cut = [said[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(said)]
        assert [w for words in codec._pieces(said) for w in words] == cut
    # Speculation, verification and merging agree; both forms of merging do.
    words = list({w.encode() for t in texts for w in t.split()} - {b""})
    rnd.shuffle(words)
    for word, ids in zip(words[:4000], codec.encode_words(words[:4000])):
        assert ids.tolist() == rules.merge(word) == rules._merge_long([rules.base[b] for b in word])
    broken = np.array([rules.base[0xF0], rules.base[0x41]], "<u4").tobytes()
    assert codec.decode(broken) == tokenizer.decode([rules.base[0xF0], rules.base[0x41]], skip_special_tokens=False)


def test_differencing_sees_every_page(spark, monkeypatch):
    """Pages that mark their article are compared too: a line that neighbours share is found, and stays where markup says so."""
    from murmuration.llm import html_extract

    seen, write = {}, html_extract.materialize
    monkeypatch.setattr(html_extract, "materialize", lambda df, name: seen.setdefault(name, write(df, name)))
    page = lambda k: f"<body><p>menu of the site</p><article><p>shared words</p><p>{'own words ' * 9}{k}</p></article></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(7)] + [(7, None, page(7))]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {k: f"shared words\n{'own words ' * 9}{k}" for k in range(8)}
    told = seen["compared"].where("role IN ('done', 'open')")
    assert told.count() == 7 and {tuple(r.shared) for r in told.where("role = 'done'").collect()} <= {(True, True, False)}


def test_postings_are_shuffled_packed(spark, monkeypatch):
    from murmuration.llm import ngram_join

    plans, write = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    text = "a b c d e f g h i j k l m n o p q r s t"
    docs = spark.createDataFrame([(1, text), (2, text + " u"), (3, "x y z " * 9)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicate_documents(docs, 4, 85, 100).collect()} == {1: 1, 2: 1, 3: 3}
    above, below = plans["postings"].split("Exchange hashpartitioning(list", 1)
    assert " AS at#" in below and all(f" AS {c}#" in above and f" AS {c}#" not in below for c in ("n", "h", "_w0"))
