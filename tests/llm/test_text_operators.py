"""Operators on whole texts against brute force, with odd inputs."""

import collections
import hashlib
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, fingerprints, language, licences, privacy, queries, resample

LONG = "lorem ipsum " * 30_000
ODD = [None, "", "   ", "a", "Ünïcödé — 漢字 😀", LONG, "x" * 50_000, "same text here", "same text here", "\x00\x01", "don't  stop\n\n now "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.5, ["s"]) for i, t in enumerate(ODD)] + [(None, "no id", "de", 0.0, [])]
    rows += [rows[3], rows[3]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, spans array<string>")


def empty(df):
    return df.where("false")


def brute_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# byte-level BPE


def test_bpe_equals_the_library(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = queries.tokenizer()
    library = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = bpe.encode(odd, vocabulary, keep=["doc_id", "text"])
    for row in got.collect():
        ids = library.encode_ordinary(row["text"] or "")
        assert row["ids"] == struct.pack(f"<{len(ids)}I", *ids)
        assert row["n_tokens"] == len(ids)
    back = bpe.decode(got, vocabulary, keep=["text"]).collect()
    assert len(back) == odd.count()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)
    assert bpe.encode(empty(odd), vocabulary, keep=["doc_id"]).count() == 0


def test_bpe_merges_leftmost_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    encoder = bpe.Encoder(bpe.Vocabulary(ranks, ".+"))
    assert encoder.merge(b"aaaaa") == [256, 257]
    assert encoder.merge(b"aab") == [256, ord("b")]
    assert encoder.merge(b"xab") == [ord("x"), 258]


# decontamination


def test_contamination_by_brute_force(spark, odd):
    items = [("1", "same text here"), ("2", "w" + " w".join(map(str, range(40)))), ("3", None), ("4", "!!"), (None, "a"), ("5", "same text here")]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(90, "Zz w0 W1 " + " ".join(f"w{i}" for i in range(2, 30)) + " end"), (91, "not same. Text, here!"), (91, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for item, text in items:
        words = brute_words(text)
        if item is not None:
            for at in range(max(len(words) - 13, 0) + 1 if words else 0):
                windows.setdefault(tuple(words[at : at + 13]), set()).add(item)
    want = []
    for doc, text in docs:
        words = brute_words(text)
        hit, found = set(), set()
        for window, owners in windows.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found |= owners
        want.append((doc, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    for options in ({}, {"block_bytes": 40, "keep": ["doc_id", "text"]}, {"shard_bytes": 100}):
        got = decontaminate.with_verdict(decontaminate.find_contamination(df, bench, **options))
        got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in got.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    none = decontaminate.find_contamination(df, empty(bench)).collect()
    assert len(none) == len(docs) and not any(r["spans"] for r in none)
    assert decontaminate.find_contamination(empty(odd), bench).count() == 0
    assert decontaminate.find_contamination(odd, bench).columns.count("spans") == 1


def test_several_blocks_and_items_without_id(spark, tmp_path):
    items = [("1", "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), ("3", "red green blue white black"), (None, "one two three four five six seven")]
    docs = [(1, "x alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven y"), (3, "nothing at all"), (4, items[0][1] + " " + items[1][1]), (5, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {1: (7, [(1, 7)], ["1"]), 2: (8, [(0, 7)], []), 3: (3, [], []), 4: (13, [(0, 13)], ["1"]), 5: (0, [], [])}
    for block_bytes in (40, 1 << 20):
        got = decontaminate.find_contamination(df, bench, keep=["doc_id"], block_bytes=block_bytes, nameless=True)
        assert got.columns == ["doc_id", "n_words", "spans", "items"]
        assert {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in got.collect()} == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.op10_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {1, 2, 4}


def test_index_finds_every_phrase():
    import numpy as np

    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 5, 3000)
    symbols[1000:1500] = symbols[:500]  # a long repetition
    index = decontaminate.FmIndex(symbols, 5)
    phrases = [symbols[at : at + size] for at in (0, 7, 990, 1200, 2990) for size in (1, 3, 10)] + [np.array([4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4])]
    sizes = np.array([len(p) for p in phrases])
    low, high = index.search(np.concatenate(phrases), np.cumsum(sizes) - sizes, sizes)
    for phrase, a, b in zip(phrases, low, high):
        want = [i for i in range(len(symbols) - len(phrase) + 1) if (symbols[i : i + len(phrase)] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum((2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def plain_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if plain_valid(k, m[0]))


def test_base_spans_by_brute_force(spark):
    texts = [
        *ODD[:5],
        "a@b.c.d@e.f, x_y@z.w. é1@ü.de é@a.b a@b.c_x@y.z %@-.-.",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2..3.4.5.6",
        "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111112 0000 0000 0000 0000",
        "+1 (555) 123-4567 ++49.30.1234567 +1 2 3 +12345678901234567",
        "4" * 30_000,
        "a." * 20_000 + "@b.c",
        "+1" + "-2" * 20_000,
        "1." * 20_000,
        "x@y.z " * 500,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = df.select("doc_id", privacy.span_text(privacy.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert {r[0]: r[1] for r in got} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_terms_that_give_an_entity_away(spark, odd):
    told = ["Call Zorblatt at z@b.com today please.", "Ask for Zorblatt or write z@b.com now.", "The office of Zorblatt is z@b.com indeed."]
    copies = [f"Write to Quimby at q@r.com about {w}." for w in ["this"] * 30 + ["that"]]  # one sentence and a variant
    rest = [f"The day {i} is a normal day for the people and they call today now." for i in range(60)]
    docs = [(i, t, "k") for i, t in enumerate([*told, *copies, *rest, None, "", "Zorblatt alone"])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, key string")
    found = privacy.find_personal_data(df)
    rows = found.withColumn("clean", privacy.sanitised(F.col("text"), F.col("spans"))).collect()
    clean = {r["doc_id"]: r["clean"] for r in rows}
    assert clean[0] == "Call [WORD] at [EMAIL] today please."
    assert "Quimby" in clean[3] and "[EMAIL]" in clean[3]
    assert clean[len(docs) - 1] == "Zorblatt alone" and clean[len(docs) - 3] is None
    assert all(clean[i] == docs[i][1] for i in range(34, 94))
    assert privacy.find_personal_data(empty(odd)).count() == 0
    assert privacy.find_personal_data(odd).count() == odd.count()


def test_terms_that_independent_sentences_share(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    texts, want = [f"plain sentence of {word()}." for _ in range(3000)], set()
    for shared in (1, 2, 3, 5):
        for count in (2, 50):
            names = [word() for _ in range(shared)]
            texts += [" ".join([f"{names[0]}@b.com", *names, *(word() for _ in range(10 - shared))]) + "." for _ in range(count)]
            want |= {(f"{names[0]}@b.com", name) for name in names}
    same = [word() for _ in range(9)]
    texts += [" ".join(["v@b.com", *same, word()]) + "." for _ in range(50)]  # variants of one sentence
    got = privacy.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {(r["entity"], r["term"]) for r in got} == want and len(got) == len(want)


# licences


def test_licence_rules(spark, odd):
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3"],
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.": ["apache-2.0", "MIT"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0"],
        "/* SPDX-License-Identifier: BSD-3-Clause */": ["bsd-3-clause"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
        "The above copyright notice and this permission notice shall be included in all copies.": ["MIT"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted.\n"
        "* Redistributions of source code must retain the above copyright notice.\n"
        "* Redistributions in binary form must reproduce the above copyright notice.": ["BSD-2-Clause"],
        "Licence terms apply. Licensed under the moon.": ["unknown"],
        "No terms here.": [],
    }
    df = spark.createDataFrame([(t, "old") for t in texts], "text string, licences string")
    assert {r["text"]: r["licences"] for r in licences.scan_licences(df).collect()} == texts
    got = licences.scan_licences(odd)
    assert got.count() == odd.count() and got.where("size(licences) > 0").count() == 0
    assert licences.scan_licences(empty(odd)).count() == 0


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped_licence_texts(spark):
    lgpl = GPL.replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ")
    agpl = GPL.replace("GNU General", "GNU Affero General").replace("version 2 ", "version 3 ")
    holder = "Copyright (c) 2020, A. Nyone\nAll rights reserved.\n\n"
    commented = lambda text, mark: "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))
    texts = {
        holder + GRANT: ["MIT"],
        "Copyright 2020 A\n" + GRANT: ["MIT"],
        holder + BSD: ["BSD-2-Clause"],
        holder + BSD + ENDORSE: ["BSD-3-Clause"],
        "Copyright 2020 A\n\n" + ISC: ["ISC"],
        APACHE: ["apache-2.0"],
        GPL: ["gpl-2+"],
        GPL.replace("\n", " "): ["gpl-2+"],
        GPL.replace(", or\n(at your option) any later version", ""): ["gpl-2"],
        lgpl: ["lgpl-2.1+"],
        agpl: ["agpl-3+"],
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not": ["mpl-2.0"],
        "Licensed under CC BY-NC 4.0\nReleased under the MIT License": ["cc-by-nc-4.0", "MIT"],
        "GNU General Public License\nApache License, Version 2.0": ["apache-2.0", "gpl-any"],
        "// SPDX-License-Identifier: MIT\n// Copyright A\n// a file": ["mit"],
    }
    texts |= {commented(text, mark): found for text, found in list(texts.items())[:11] for mark in ("#", " *", "//")}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["licences"] for r in licences.scan_licences(df).collect()}
    assert {t: sorted(f) for t, f in got.items()} == {t: sorted(f) for t, f in texts.items()}


# language


def test_language_backs_off_and_rejects(spark, odd):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("nothing", None)] * 20)]
    model = language.fit(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    tests = [("THE garden", "en"), ("das gartenhaus", "de"), ("theand", "en"), (None, "und"), ("12 ?!", "und"), ("", "und")]
    df = spark.createDataFrame([(t, 1) for t, _ in tests], "text string, score int")
    got = language.predict(df, model, keep=["text", "score"]).collect()
    assert [(r["text"], r["lang_pred"]) for r in got] == tests
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len(language.predict(odd, model, keep=odd.columns).collect()) == odd.count()
    untaught = language.fit(empty(odd))
    assert {r["lang_pred"] for r in language.predict(odd, untaught, keep=["doc_id"]).collect()} == {"und"}
    assert language.predict(empty(odd), model, keep=["doc_id"]).count() == 0


def test_rare_languages_are_learned(spark):
    train = [(i, "the house and the garden", "en") for i in range(3000)] + [(5000 + i, "das haus und der garten", "de") for i in range(2)]
    model = language.fit(spark.createDataFrame(train, "doc_id bigint, text string, lang string"), sample_rows=20)
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([("das haus",), ("the garden",)], "text string")
    assert {r["text"]: r["lang_pred"] for r in language.predict(df, model, keep=["text"]).collect()} == {"das haus": "de", "the garden": "en"}


def test_language_on_held_out_documents(spark, sf):
    got = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


# resampling


def test_resampling_prefers_the_target(spark, odd):
    good = [(i, f"alpha beta gamma word{i % 5}") for i in range(50)]
    bad = [(100 + i, f"delta epsilon zeta word{i % 5}") for i in range(50)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 50, 2)], "doc_id bigint")
    rows = resample.resample(df, target, share=0.5).collect()
    assert sum(r["selected"] for r in rows) == 50
    assert sum(r["selected"] for r in rows if r["doc_id"] < 50) >= 45
    assert sorted(map(tuple, rows)) == sorted(map(tuple, resample.resample(df.repartition(7), target, share=0.5).collect()))
    assert resample.resample(odd, target).count() == odd.count()
    assert resample.resample(empty(odd), target).count() == 0
    assert resample.resample(df, empty(target), share=0.0).where("selected").count() == 0


def test_kth_largest(spark):
    values = [0.5, 0.5, 2.0, -1e300, 7.25, 7.25, 1e-9, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [resample.kth_largest(df, "v", k) for k in range(1, 9)] == sorted(values, reverse=True)


# fingerprints


def test_fingerprints_of_edited_and_next_texts(spark, odd):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    order = sorted(docs, key=lambda d: -1 if d[0] is None else d[0], reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(df).collect()}
    assert len(got) == len(docs)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if edited == text:
            assert row["near_edited"] == 1 and row["edited_fingerprint"] == row["fingerprint"]
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[8]["near_next"] == 1
    assert got[None]["edited_sha256"] is not None
    assert fingerprints.compare_neighbours(odd).count() == odd.count()  # repeated rows
    assert fingerprints.compare_neighbours(empty(odd)).count() == 0


def test_collisions_estimate_generalised_jaccard(spark):
    bags = [({"a": 4, "b": 1, "c": 2}, {"a": 2, "b": 1, "d": 3}), ({"a": 1, "b": 1}, {"a": 1, "b": 1, "c": 1, "d": 1}), ({"x": 5}, {"x": 2})]
    rows = [(i, side, k, w) for i, pair in enumerate(bags) for side, bag in enumerate(pair) for k, w in bag.items()]
    df = spark.createDataFrame(rows, "i int, side int, term string, w int")
    term, log_weight = F.xxhash64("term"), F.log(F.col("w").cast("double"))
    count = 400
    signed = df.groupBy("i", "side").agg(*[F.min(fingerprints.sample_value(term, log_weight, d)).alias(f"s{d}") for d in range(count)])
    found = {(r["i"], r["side"]): r[2:] for r in signed.collect()}
    for i, (a, b) in enumerate(bags):
        terms = a.keys() | b.keys()
        want = sum(min(a.get(t, 0), b.get(t, 0)) for t in terms) / sum(max(a.get(t, 0), b.get(t, 0)) for t in terms)
        got = sum(x == y for x, y in zip(found[i, 0], found[i, 1])) / count
        assert abs(got - want) < 0.08


def test_samples_take_four_bytes_and_are_what_is_printed(spark):
    df = spark.createDataFrame([(1, ""), (2, "one two three"), (3, "One two three"), (4, "b " * 500)], "i bigint, text string")
    signed = fingerprints.fingerprint(df, ["i"], []).withColumn("samples", fingerprints.short(F.col("samples")))
    assert dict(signed.dtypes)["samples"] == "array<int>"
    for row in signed.select("samples", fingerprints.printable(F.col("samples")).alias("text")).collect():
        assert row["text"] == "".join(f"{s % (1 << 32):08X}" for s in row["samples"])


def test_only_terms_above_the_limit_are_passed_over(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("term"), (F.col("id") % 3 + 1).cast("double").alias("n"))
    once = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    limit = 0.02
    for d in range(3):
        whole = fingerprints.sample_value(F.col("term"), F.log("n"), d)
        part = fingerprints.sample_value(F.col("term"), F.log("n"), d, limit * F.col("n"), once)
        got = df.select(whole.alias("whole"), part.alias("part")).collect()
        assert all(r["part"] == r["whole"] or (r["part"] == float("inf") and r["whole"] > math.log(limit)) for r in got)
        assert sum(r["part"] == float("inf") for r in got) > 2000


def test_fingerprints_do_not_depend_on_the_reach(spark):
    texts = [" ".join(f"w{i % (j + 2)}" for i in range(7 * j)) for j in range(12)] + [None, "", "one", "one"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (3, "again three")], "doc_id bigint, text string")
    want, *others = (sorted(map(repr, fingerprints.compare_neighbours(df, 4, reach).collect())) for reach in (None, 1.0))
    assert others == [want]  # with 1.0 most texts are done again


def test_likenesses_are_close_to_the_true_ones(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):  # every second text is followed by a copy with four words in a row replaced
        words = [f"w{rng.randrange(10**6)}" for _ in range(45)]
        texts += [" ".join(words), " ".join(words[:20] + [f"e{rng.randrange(10**6)}" for _ in range(4)] + words[24:])]
    df = spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {-r["doc_id"]: r for r in fingerprints.compare_neighbours(df).collect()}
    assert all(len(r["fingerprint"]) >= 8 * 64 for r in got.values())
    errors = [got[i]["near_next"] - 40 / 50 for i in range(0, len(texts), 2)]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.075
    assert got[1]["near_next"] == 0


# cases of the contracts that the tables do not hold


def test_languages_of_any_name_and_only_letters(spark):
    names = ["term", "back`tick", "a.b", "n"]
    rows = [(i, f"{w} {w}x {w}y", n, 0) for i, (n, w) in enumerate(zip(names * 3, ["alpha", "beta", "gamma", "delta"] * 3))]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int"))
    assert model.languages == sorted(names)
    texts = ["alpha", "²½", "① Ⅷ", "12 ٣ _", "beta² ½", "Été"]
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, keep=["doc_id"])
    found = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert [found[i] for i in range(4)] == ["term", "und", "und", "und"] and found[4] == "back`tick" and found[5] != "und"
    assert language.letter_words("a²½b Ⅷ ① été 漢字 x_1") == ["a", "b", "été", "漢字", "x"]


def test_predictions_equal_a_plain_scorer(spark):
    rng = random.Random(8)
    words = {"en": ["the", "house", "walks"], "de": ["das", "haus", "geht"], "fr": ["le", "maison", "marche"]}
    rows = [(i, " ".join(rng.choices(words[n], k=9)), n) for i, n in enumerate(["en", "de", "fr"] * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts = {n: collections.Counter(w for _, t, m in rows if m == n for w in t.split()) for n in words}
    vocabulary = {w for c in counts.values() for w in c}
    for word in vocabulary:
        for i, n in enumerate(model.languages):
            want = math.log((counts[n][word] + 0.5) / (sum(counts[n].values()) + 0.5 * len(vocabulary)))
            assert abs(model.words[word][i] - want) < 1e-5
    grams = {n: collections.Counter() for n in words}
    for n, c in counts.items():
        for w, k in c.items():
            padded = f"_{w}_"
            for size in range(1, 6):
                for at in range(len(padded) - size + 1):
                    if padded[at : at + size] != "_":
                        grams[n][padded[at : at + size]] += k
    known = {g for c in grams.values() for g in c}

    def vector(word):
        if word in vocabulary:
            return [math.log((counts[n][word] + 0.5) / (sum(counts[n].values()) + 0.5 * len(vocabulary))) for n in model.languages]
        padded = f"_{word}_"
        for size in range(min(5, len(padded)), 0, -1):
            held = [g for at in range(len(padded) - size + 1) if (g := padded[at : at + size]) in known]
            if held:
                logs = [[math.log((grams[n][g] + 0.5) / (sum(grams[n].values()) + 0.5 * len(known))) for n in model.languages] for g in held]
                return [sum(x) / len(held) for x in zip(*logs)]
        return [0.0] * len(model.languages)

    texts = ["the haus", "houses walked", "maisons", "gehen qq", "zzz", "le das the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in language.predict(docs, model, keep=["doc_id", "text"]).collect():
        vectors = [vector(w) for w in r["text"].split()]
        total = [sum(v) for v in zip(*vectors)]
        best = max(range(len(total)), key=lambda i: (round(total[i], 4), -i))
        share = [math.exp(v[best]) / sum(map(math.exp, v)) for v in vectors]
        assert r["lang_pred"] == model.languages[best] and abs(r["score"] - sum(share) / len(share)) < 1e-3


def test_items_of_one_id_count_once(spark):
    docs = spark.createDataFrame([(1, "one two three and four five six")], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "one two three"), ("x", "four five six"), ("y", "two three and"), ("x", "one two three")], "item_id string, text string")
    for size in (1 << 20, 10):
        (row,) = decontaminate.find_contamination(docs, items, keep=["doc_id"], block_bytes=size).collect()
        assert sorted(row["items"]) == ["x", "y"]
