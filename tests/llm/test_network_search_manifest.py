"""Toxicity network, lexical search and Merkle manifest against brute force, with odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lexical, merkle, queries, toxicity

LONG = "lorem ipsum " * 20_000
ODD = [None, "", "   ", "a", "Ünïcödé — 漢字 😀", LONG, "x" * 5_000, "same text here", "same text here", "\x00\x01", "don't  stop\n\n now "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.5, 3) for i, t in enumerate(ODD)] + [(None, "no id", "de", 0.0, 1)]
    rows += [rows[3], rows[3]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, rank int")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# toxicity


def some_tokens(texts):
    ((_, _, data, borders),) = toxicity.text_slices(pa.array(texts))
    return toxicity.Tokens(data, borders)


def test_gradients_equal_differences():
    tokens = some_tokens(["one two three unseen words here", "two three four", "a longer text of several words with one more"])
    vocabulary = np.sort(tokens.hashes[:6])
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network(6, 3, 3, 3, 3, 4, 3).items()}
    first, size = np.array([0, 6, 9]), np.array([6, 3, 9])
    label = np.array([1.0, 0.0, 1.0])
    tokens.mask = tokens.mask.astype(np.float64)
    _, grads = toxicity.loss_and_gradients(net, vocabulary, tokens, first, size, label)
    draw = np.random.default_rng(1)
    for name, values in net.items():
        for _ in range(4):
            at = tuple(int(draw.integers(n)) for n in values.shape)
            if name == "word" and at[0] == 0:
                continue
            found = []
            for step in (1e-5, -1e-5):
                other = {k: v.copy() for k, v in net.items()}
                other[name][at] += step
                found.append(toxicity.loss_and_gradients(other, vocabulary, tokens, first, size, label)[0])
            assert abs((found[0] - found[1]) / 2e-5 - grads[name][at]) < 1e-6, (name, at)


def plain_encoder(net, name, inputs):
    """The same network word by word."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = len(net[f"{name}.on.state"])
    both = []
    for way, order in (("on", 1), ("back", -1)):
        h, states = np.zeros(hidden), []
        for x in inputs[::order]:
            a, b = x @ net[f"{name}.{way}.in"] + net[f"{name}.{way}.bias"], h @ net[f"{name}.{way}.state"]
            r, z = sigmoid(a[:hidden] + b[:hidden]), sigmoid(a[hidden : 2 * hidden] + b[hidden : 2 * hidden])
            n = np.tanh(a[2 * hidden :] + r * b[2 * hidden :])
            h = (1 - z) * n + z * h
            states.append(h)
        both.append(states[::order])
    states = [np.concatenate(s) for s in zip(*both)]
    weight = np.array([np.tanh(s @ net[f"{name}.attend"] + net[f"{name}.shift"]) @ net[f"{name}.pick"] for s in states])
    weight = np.exp(weight - weight.max())
    return sum(w * s for w, s in zip(weight / weight.sum(), states))


def plain_score(net, known, text):
    words = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    words = [w[at : at + toxicity.LONGEST] for w in words for at in range(0, len(w), toxicity.LONGEST)]
    if not words:
        return 0.0, 0
    inputs = []
    for word in words:
        spelled = plain_encoder(net, "spelling", [net["character"][ord(c) % toxicity.CHARACTERS] for c in word])
        inputs.append(np.concatenate([net["word"][known.get(word, 0)], spelled]))
    starts = range(0, max(len(words) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE)
    starts = [s for s in starts if s == 0 or s - toxicity.STRIDE + toxicity.WINDOW < len(words)]
    logits = [plain_encoder(net, "window", inputs[s : s + toxicity.WINDOW]) @ net["out"] + net["out.bias"][0] for s in starts]
    return 1 / (1 + math.exp(-max(logits))), len(starts)


def test_scores_equal_a_plain_network(spark, odd):
    import pickle

    texts = ["same words here", "you absolute fool", *(" ".join(f"w{(i * k) % 17}" for i in range(n)) for k, n in ((3, 47), (5, 48), (7, 49), (2, 72), (9, 73), (4, 200)))]
    net, vocabulary = toxicity.train(texts * 4, [0, 1] * (len(texts) * 2), epochs=1)
    hash_of = lambda w: some_tokens([w]).hashes[0]
    words = {w for t in texts for w in t.split()}
    known = {w: int(np.searchsorted(vocabulary, hash_of(w))) + 1 for w in words if hash_of(w) in vocabulary}
    small = [t for t in ODD if t is None or len(t) < 10_000] + texts
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(small)], "doc_id bigint, text string, predicted int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, pickle.dumps((net, vocabulary)), keep=docs.columns).collect()}
    assert len(got) == len(small)
    for i, text in enumerate(small):
        score, windows = plain_score(net, known, text)
        assert abs(got[i]["score"] - score) < 1e-4 and got[i]["n_windows"] == windows and got[i]["text"] == text
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_toxicity_of_odd_rows(spark, odd):
    assert toxicity.fit(odd, odd.select("doc_id", F.lit(1).alias("toxic"))) is None
    assert toxicity.fit(odd, odd.select("doc_id", F.lit(None).cast("int").alias("toxic"))) is None
    labels = odd.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    assert toxicity.fit(odd.where("doc_id = 4"), labels) is None  # no text for one of the labels
    model = toxicity.fit(odd, labels.union(labels).union(spark.createDataFrame([(None, 1), (99, 1), (3, 7)], "doc_id bigint, toxic bigint")), epochs=1)
    scored = toxicity.score(odd, model, keep=odd.columns).collect()
    assert len(scored) == len(ODD) + 3
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0 and r["n_windows"] == 0 for r in scored if not re.search(r"\w", r["text"] or ""))
    assert toxicity.score(odd.where("false"), model, keep=["doc_id"]).count() == 0
    assert {r["score"] for r in toxicity.score(odd, None, keep=["doc_id"]).collect()} == {0.0}


def test_toxicity_finds_held_out_insults(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic", toxicity.is_held_out(F.col("doc_id")).alias("held_out"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, labels.where("NOT held_out"))
    held = toxicity.score(docs.join(labels.where("held_out"), "doc_id"), model, keep=["toxic", "text"]).collect()
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    insulting = [r["predicted"] for r in held if r["toxic"] == 1 and re.search(r"\b(idiot|moron|stupid|scum|loser|trash)\b", r["text"] or "")]
    assert sum(clean) / len(clean) < 0.05 and sum(insulting) / len(insulting) > 0.95


# lexical search


def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best):
    counted = [(doc_id, collections.Counter(terms_of(t))) for doc_id, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc_id, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, odd):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "ß漢", "A", "a"]
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 3, 20, 200])))) for i in range(600)]
    docs += [(i + 1000, "w1 w2 w3") for i in range(40)] + [(5, "w1 w2 w3"), (None, "w1 w2 w3"), (None, None)]
    items = [(i, " ".join(draw.choices(words, k=k))) for i, k in enumerate([0, 1, 2, 5, 30] * 60)]
    items += [(3, "w1 w59 again"), (None, "w7"), (None, "w8 w9"), (900, None), (901, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7).withColumn("score", F.lit("x"))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(0))
    want = plain_search(docs, items, 10)
    for block_bytes in (lexical.BLOCK_BYTES, 900):
        got = lexical.search(d, q, block_bytes=block_bytes).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert lexical.search(d.where("false"), q).count() == 0 and lexical.search(d, q.where("false")).count() == 0
    got = lexical.search(odd, q).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search([(r["doc_id"], r["text"]) for r in odd.collect()], items, 10)
    found = lexical.search(odd, spark.createDataFrame([("i", "IPSUM same 漢字"), (None, "x")], "item_id string, text string")).collect()
    assert {r["doc_id"] for r in found} == {4, 5, 7, 8}


def test_narrow_tiles_and_large_numbers_stay_exact():
    block = lexical.ItemBlock(pa.array([1, 2]), [["a b c d"], ["b c", "e"]])
    heavy = np.full(5, (lexical.EXACT - 1) // (2 * 10**6), np.int64)  # two columns fit below 2**53
    ((_, items, parts),) = list(block.tiles(heavy))
    assert [w.shape for _, w in parts] == [(2, 2), (2, 2), (2, 1)]
    score = sum((w @ np.full((w.shape[1], 1), 999_999.0)).astype(np.int64) for _, w in parts)
    assert score[:, 0].tolist() == [4 * int(heavy[0]) * 999_999, 3 * int(heavy[0]) * 999_999]
    n = np.array([0, 10, 10**9])
    assert lexical.length_norms(n, 10**11, 10**14).tolist() == [10 + 90 * int(x) * 10**11 // 10**14 for x in n]


def test_terms_with_one_hash_are_told_apart():
    vocabulary = lexical.Vocabulary.of([b"aa", b"bb", b"cc"])
    vocabulary.hashes[:] = vocabulary.hashes[0]
    vocabulary.most = 3
    data = np.frombuffer(b"ccBBzzaa", np.uint8)
    at = np.array([0, 2, 4, 6])
    number = vocabulary.number(data, at, at + 2, np.full(4, vocabulary.hashes[0]))
    names = [vocabulary.bytes.tobytes()[2 * i : 2 * i + 2] for i in number.tolist() if i >= 0]
    assert number[2] == -1 and names == [b"cc", b"bb", b"aa"]


# Merkle manifest


def plain_manifest(rows):
    """The contract step by step: rows are (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row):
        return digest("".join(map(field, row)))

    def tampered(row):
        text = row[4]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return (*row[:4], text)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            low = at - at % 8
            out.append((nodes[low:at], nodes[at + 1 : low + 8]))
            at //= 8
        return out

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    top = tree([trees[lang][-1][0] for lang in order])
    out = []
    for number, lang in enumerate(order):
        for at, row in enumerate(groups[lang]):
            steps = path(trees[lang], at) + path(top, number)
            folded = leaf(tampered(row))
            for left, right in steps:
                folded = digest("".join([*left, folded, *right]))
            proof = digest("".join("".join(a + b) for a, b in steps))
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def build(spark, rows, levels, proofs=False):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(third, F.translate("text", queries._UPPER, queries._LOWER)).otherwise(F.col("text"))
    return merkle.manifest(merkle.leaves_of(docs, claimed), proofs=proofs, levels=levels)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("counts,levels", [({"en": 700, "é": 65, None: 9, "de": 1, "fr": 8, "aa": 64}, 1), ({"en": 521, None: 64}, 2), ({f"l{i}": 1 + i % 3 for i in range(70)}, 1), ({"en": 1}, 4)])
def test_manifest_equals_the_contract(spark, counts, levels):
    draw = random.Random(1)
    ids = iter(draw.sample(range(10**6), sum(counts.values())))
    rows = [(next(ids), draw.choice([None, "web"]), lang, draw.choice([None, 7]), draw.choice(["Text É", "low", None, ""])) for lang, n in counts.items() for _ in range(n)]
    got = build(spark, rows, levels).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(i, None, "en", None, t) for i, t in enumerate(ODD)] + [(None, "s", "en", 1, "A"), (None, None, None, None, None)] * 5
    rows += [(3, "s", "en", 2, "Same ID"), (3, "s", "en", 2, "Same ID")]
    got = build(spark, rows, 1, proofs=True).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == plain_manifest(rows)
    for r in got:  # the written proof leads from the leaf to the root
        text = r["leaf"]
        for step in r["proof"]:
            text = digest(step["left"] + text + step["right"])
        assert text == r["root"]
    assert build(spark, rows[:0] or spark.sparkContext.emptyRDD(), 1).count() == 0
