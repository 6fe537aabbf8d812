"""The n-gram join, URL rules, WARC derivatives and the pipeline."""

import random
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import near, urls, warc
from plumbline.llm.tokens import settled


def brute_components(docs, size, percent):
    sets = []
    for _, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and common * 100 >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(docs)]


def family(rng, size, copies, edits):
    """A text and copies of it with some words changed."""
    words = [f"w{rng.randrange(3000)}" for _ in range(size)]
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_components_by_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts = [t for n in (4, 12, 30, 90, 200) for t in family(rng, n, 40, 5)]
    texts += [None, "", " \t", "one", "ONE", "one two", "one  two", "b " * 2000, "b " * 50, texts[7], texts[7].upper()]
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs += [docs[9], docs[9], (None, "alone with no id at all"), (None, texts[3])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, n bigint")
    got = near.jaccard_components(df.repartition(5), size, percent)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_components(docs, size, percent), key=repr)
    assert near.jaccard_components(df.where("false"), size, percent).count() == 0


def test_large_families_need_several_rounds(spark, monkeypatch):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = list(family(rng, 120, 150, 6)) + [" ".join([f"u{rng.random()}" for _ in range(15)] + passage) for _ in range(60)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sorted(brute_components(docs, 3, 90))
    assert sorted(map(tuple, near.jaccard_components(df, 3, 90).collect())) == want
    monkeypatch.setattr(near, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, near.jaccard_components(df, 3, 90).collect())) == want


def test_labels_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in near.merge_labels(df).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


SITES = (urls.SiteRule("allow", "org", "/"), urls.SiteRule("block", "example.org", "/en/1"))


def test_url_rules(spark):
    cases = {
        "http://A.Example.org/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/En/12": ("example.org", "/En/12", "org/", "allow"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "https://www.cheap-pills.net/a": ("www.cheap-pills.net", "/a", None, "block"),
        "https://good.net/pills.html": ("good.net", "/pills.html", None, "allow"),
        "https://x.net/a/popunder/b": ("x.net", "/a/popunder/b", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://h/" + "a/" * 50_000: ("h", "/" + "a/" * 50_000, None, "allow"),
    }
    rows = [(u, "old", 1) for u in cases] + [("http://example.org", "old", 1)] * 3
    df = spark.createDataFrame(rows, "url string, verdict string, best int")
    got = urls.judge_urls(df, SITES)
    assert got.count() == len(rows) and got.columns == ["url", "best", "host", "path", "rule", "verdict"]
    assert {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == cases
    assert urls.judge_urls(df.where("false"), SITES).count() == 0
    assert urls.judge_urls(df, (), ()).where("verdict != 'allow'").count() == 0


def test_shipped_patterns(spark):
    blocked = [
        *("http://m.casino-win.example.com/en/4033.html", "https://free-bets.example.com/en/5462#top", "https://m.ads-track.example.com/en/9823"),
        *("https://blog.adult-x.example.net/fr/9689/", "http://www.spam-farm.example.com/fr/907?utm_source=feed", "https://www.cheap-pills.example.com/de/6652.html"),
        *("https://casino.example.com", "http://viagra.example.net/a", "http://XXX.example.net/", "http://h.net/adclick?x=1", "http://h.net/a/casino-bonus/", "http://h.net/porn"),
    ]
    allowed = [
        *("http://example.com/casino-win.html", "http://mycasino.example.com/", "https://h.net/en/free-bets-explained"),
        *("https://adult-education.example.org/", "http://uploads-track.example.com/", "http://grads.example.com/", "http://h.net/adclicker", "http://pillsbury.example.com/", "http://h.net/?u=http://a/adult"),
    ]
    df = spark.createDataFrame([(u,) for u in [*blocked, *allowed]], "url string")
    got = {r["url"]: r["verdict"] for r in urls.judge_urls(df, ()).collect()}
    assert got == dict.fromkeys(blocked, "block") | dict.fromkeys(allowed, "allow")


def test_rules_are_filed_under_whole_tokens():
    assert urls.rule_tokens(urls.PatternRule("block", "ads/banner*")) == []
    assert urls.rule_tokens(urls.PatternRule("block", "/ads/ban*ner^x|")) == ["ads", "x"]
    assert urls.rule_tokens(urls.PatternRule("block", "||spam-")) == ["spam"]
    assert urls.rule_tokens(SITES[1]) == ["en", "example", "org"]


def test_warc_derivatives(spark):
    page = "<html lang='fr'><head><title>T &amp; t</title><style>p{}</style></head><body><p>Un<br>deux &lt;3<script>x</script></p><a href='/l'>lien</a></body>"
    rows = [(1, "http://h/é", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, "u", "<" * 20_000 + "a" * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string")
    responses = warc.responses_of_pages(pages)
    got = warc.derive(responses, keep=["page_id", "block"]).collect()
    assert len(got) == 2 * len(rows)
    source = {r["page_id"]: r["record_id"] for r in responses.collect()}
    for r in got:
        assert r["refers_to"] == source[r["page_id"]]
        ((headers, block),) = warc.read_records(bytes(r["record"]))
        headers = dict(headers)
        assert headers["WARC-Type"] == r["record_type"] and headers["WARC-Refers-To"] == r["refers_to"]
        assert headers["WARC-Block-Digest"] == r["block_digest"] == warc.digest(block)
        assert headers.get("WARC-Target-URI") == r["target_uri"] and block == bytes(r["block"])
    first = {r["record_type"]: r for r in got if r["page_id"] == 1}
    assert bytes(first["conversion"]["block"]).decode() == "Un\ndeux <3\nlien"
    about = bytes(first["metadata"]["block"]).decode()
    assert "title: T & t\r\n" in about and "outlink: /l\r\n" in about and warc.digest(page.encode()) in about
    assert warc.derive(responses.where("false"), keep=["page_id"]).count() == 0


def test_text_behind_unclosed_parts(spark):
    cases = {
        "<head><title>x</title><p>text": ("text", []),
        "<html><head lang='a'>\n<meta charset=utf-8><title>x</title><link rel=a>plain text<p>more</p>": ("plain text\nmore", []),
        "<head><title>x</title><script>s</script></head><body>b": ("b", []),
        "<head><title>x</title><header>top</header><a href='/l'>l</a>": ("top\nl", ["/l"]),
        "<p>a<svg width='1>' /> b <a href=\"/m\">c</a></p><p>d": ("a b c\nd", ["/m"]),
        "a<svg viewBox='0'><path d='x'/><text>t</text></svg>b": ("a b", []),
        "a<svg/>b<svg>c</svg>d": ("a b d", []),
    }
    rows = [(i, "http://h/", page) for i, page in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.derive(warc.responses_of_pages(pages), keep=["page_id"]).collect()
    blocks = {(r["page_id"], r["record_type"]): bytes(r["block"]).decode() for r in got}
    for i, (text, links) in enumerate(cases.values()):
        assert blocks[i, "conversion"] == text
        assert re.findall("outlink: (.*)\r\n", blocks[i, "metadata"]) == links


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(1)
    base = list(family(rng, 80, 3, 1))
    passage = " ".join(f"q{i}" for i in range(20))
    docs = [(1, base[0], "en"), (2, base[0], "en"), (3, base[1], "en"), (4, "12 34", "en"), (5, None, None), (6, passage + " and more", "en")]
    docs += [(7, "write to me at a.b@c.org today my friend", "en"), (8, "a clean text of its own", "de"), (None, "no id but words", "en"), (8, "a clean text of its own", "de")]
    rows = [(d, t, lang, "s", len(t or ""), 0.5) for d, t, lang in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = df
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == df.columns
        seen[name] = sorted((r["doc_id"] for r in kept.collect()), key=lambda d: d or 0)
    assert seen["language"] == [None, 1, 2, 3, 6, 7, 8, 8]
    assert seen["near_copies"] == [None, 1, 6, 7, 8]
    assert seen["decontamination"] == [None, 1, 7, 8]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert text[7] == ("write to me at [EMAIL] today my friend", 38) and text[8] == ("a clean text of its own", 23)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(final.columns) == ["doc_id", "ids", "lang", "n_tokens", "score", "source"] and final.count() == 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0


def test_only_linked_rows_go(spark):
    rng = random.Random(4)
    texts = [next(family(rng, 60, 1, 0)) for _ in range(4)]
    docs = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, texts[3]), (4, ""), (4, ""), (None, texts[0] + " x")]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id bigint, text string, source string")
    got = corpus_pipeline.near_copy_stage(spark, df.repartition(5), "")
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3]), (4, "")]
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_site_rules_end_at_the_host_and_columns_may_have_any_name(spark):
    found = {"a": "http://example.org", "b": "http://example.organic.net/x", "c": "http://www.example.org/y?z", "d": "http://example.org:80/"}
    pages = spark.createDataFrame([(k, u, 1, 2, 3, 4) for k, u in found.items()], "id string, url string, _best int, _allowed int, _row int, token int")
    judged = urls.judge_urls(pages, [urls.SiteRule("block", "example.org", "")])
    assert {r["id"]: r["verdict"] for r in judged.collect()} == {"a": "block", "b": "allow", "c": "block", "d": "allow"}
    assert judged.columns == [*pages.columns, "host", "path", "rule", "verdict"]


def test_links_and_tags_with_quotes():
    page = '<a data-href="x" href="y">z</a> <a title="a>b" href=\'q\'>w</a><a class=c id href=u>v</a><abbr href="no">'
    assert ["".join(f) for f in warc._LINK.findall(page)] == ["y", "q", "u"]
    assert warc.visible_text('<p><a title="a>b" href="y">z</a> 1 < 2 <b>x</b> <i class="o>pen</p>t') == "z 1 < 2 x pen\nt"


def test_near_copies_keep_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 5), (2, text, 6), (None, text, 7), (3, "other words that have no copy at all", 8), (3, text + " eleven", 9), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int")
    kept = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[5]], key=repr)


def test_stages_send_texts_to_python_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    rows = [(i, f"the garden number {i} is green", "en", "web", 0) for i in range(4)] + [(9, "das haus ist rot", "de", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.language_stage(spark, docs, "")
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 500).alias("text"))  # 12 MB in one task
    assert max(r["size"] for r in long.mapInArrow(sizes, "size bigint").collect()) < 5 << 20


def test_settled_tables_leave_no_shuffle_files(spark):
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {p for f in folders for p in f.glob("*/shuffle_*.data")}
    before = shuffles()
    rows = spark.range(5000).repartition(3).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    kept = settled(rows, "test")
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert kept.agg(F.sum("s")).first()[0] == sum(range(5000)) and rows.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_answers_go_only_with_places_in_joined_blocks(spark, monkeypatch):
    # of sets of 10 elements with percent 80, places 0 and 1 can meet, and place 9 has too little behind it; 30 is too large
    rows = [(1, 11, 10, 0, 11, 12), (1, 12, 10, 1, 12, 12), (1, 13, 10, 9, 13, 12), (1, 14, 30, 0, 12, 12), (2, 12, 10, 0, 12, 12)]
    member = spark.createDataFrame(rows, "key bigint, set bigint, n bigint, at bigint, root bigint, main bigint")
    x, y = near._joined_blocks(member, 80)
    assert {(r["set_x"], r["n_y"], r["at_y"]) for r in x.collect()} == {(11, 10, 0), (11, 10, 1)}
    assert {(r["key"], r["set_y"]) for r in y.collect()} == {(1, 11), (1, 12)}
    tables = {}
    monkeypatch.setattr(near, "settled", lambda df, label: tables.setdefault(label, []).append(df.columns) or settled(df, label))
    rng = random.Random(8)
    docs = spark.createDataFrame([*enumerate(family(rng, 80, 60, 6))], "doc_id bigint, text string")
    near.jaccard_components(docs, 3, 90)
    assert "pairs" in tables
    assert not [c for columns in tables.values() for c in columns if {"key", "seen"} <= set(c)]


def test_near_copies_shuffle_texts_once(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7}") for i in range(50)], "doc_id bigint, text string")
    kept = corpus_pipeline.near_copy_stage(spark, docs, "")
    plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    moved = [p for p in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan) if "text#" in p]
    assert len(moved) == 1
