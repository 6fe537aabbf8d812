"""Registered queries of the training-data operators. Importing this module fills the registry."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, fingerprints, language, lexical, licences, merkle, near, privacy, resample, toxicity, urls, warc
from plumbline.registry import query
from plumbline.session import load


def documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


@query("op1_importance_resampling")
def op1_importance_resampling(spark, sf):
    good = load(spark, sf, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return resample.resample(documents(spark, sf), good)


@query("op2_warc_derivatives")
def op2_warc_derivatives(spark, sf):
    return warc.derive(warc.responses_of_pages(load(spark, sf, "pages")), keep=["page_id"])


@query("op3_weighted_sampling")
def op3_weighted_sampling(spark, sf):
    return fingerprints.compare_neighbours(documents(spark, sf))


@query("op4_licence_sentences")
def op4_licence_sentences(spark, sf):
    return licences.scan_licences(documents(spark, sf)).drop("text")


def tokenizer() -> bpe.Vocabulary:
    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf):
    return bpe.encode(documents(spark, sf), tokenizer(), keep=["doc_id"], digests=True)


@query("op6_information_privacy")
def op6_information_privacy(spark, sf):
    found = privacy.find_personal_data(documents(spark, sf))
    base = F.filter("spans", lambda s: s["kind"].isin(*privacy.KINDS))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in privacy.KINDS]
    digest = F.sha2(privacy.span_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, privacy.span_text(F.col("spans")).alias("spans"))


SITE_RULES = (
    urls.SiteRule("allow", "org", "/"),
    urls.SiteRule("block", "example.org", "/es/"),
    urls.SiteRule("block", "example.org", "/en/1"),
    urls.SiteRule("allow", "com", "/fr/"),
    urls.SiteRule("block", "com", "/de/"),
)

_SITES_SQL = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in SITE_RULES)

OP7_SQL = f"""
WITH sites(action, rule_host, rule_path) AS (VALUES {_SITES_SQL}),
u AS (SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(url) AS low, regexp_extract(rest, '^[^/?#]*') AS raw_host,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, (SELECT max_by(struct_pack(rule := rule_host || rule_path, action := action), length(rule_host || rule_path)) FROM sites
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE WHEN
    regexp_matches(low, '^[^/?#]*://([^/?#]*\\.)?adult-({"|".join(urls.ADULT_ALLOWED)})') THEN 'allow' WHEN
    regexp_matches(low, '^[^/?#]*://([^/?#]*\\.)?spam-') OR low LIKE '%-pills.%' OR
    regexp_matches(low, '[^a-z0-9_.%-]casino([^a-z0-9_.%-]|$)') OR regexp_matches(low, '/adclick([^a-z0-9_.%-]|$)') OR
    low LIKE '%://%/popunder/%' OR regexp_matches(low, '^[^/?#]*://([^/?#]*\\.)?({"|".join(urls.HOST_WORDS)})[-.]') OR
    regexp_matches(low, '/({"|".join(urls.PATH_WORDS)})([^a-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m"""


@query("op7_url_rules", OP7_SQL)
def op7_url_rules(spark, sf):
    return urls.judge_urls(load(spark, sf, "pages").select("page_id", "url"), SITE_RULES).drop("url")


@query("op8_language_id")
def op8_language_id(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.is_held_out(F.col("doc_id")))
    model = language.fit(docs.where("NOT held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark, sf):
    return near.jaccard_components(documents(spark, sf), words=3, percent=90)


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf):
    found = decontaminate.find_contamination(documents(spark, sf), load(spark, sf, "benchmark"), keep=["doc_id"], nameless=True)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return decontaminate.with_verdict(found).select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "spans")


@query("op11_toxicity_network")
def op11_toxicity_network(spark, sf):
    docs = documents(spark, sf).withColumn("held_out", toxicity.is_held_out(F.col("doc_id")))
    labels = load(spark, sf, "labels").where(~toxicity.is_held_out(F.col("doc_id")))
    model = toxicity.fit(docs.where("NOT held_out"), labels.select("doc_id", "toxic"))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (SELECT i.item_id, n.doc_id, n.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n.n * n_docs) // n_terms))))::BIGINT AS score
    FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), c GROUP BY i.item_id, n.doc_id, n.r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {lexical.BEST}"""


@query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark, sf):
    return lexical.search(documents(spark, sf), load(spark, sf, "benchmark"))


def _merkle_sql(levels: int = 10, top_levels: int = 6) -> str:
    """Reference statement of the manifest, for up to ``8 ** levels`` rows of a language."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    start = " || ".join(field(c) for c in merkle.FIELDS[:-1])
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda a, b: "
        "list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))"
    )
    parts = [
        f"d AS (SELECT *, {start} AS head, xor({crc}, 4294967295) % 3 = 0 AS third FROM documents)",
        f"l AS (SELECT doc_id, lang, sha256(head || {field('text')}) AS leaf, sha256(head || CASE WHEN third THEN "
        f"{field(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {field('text')} END) AS claim FROM d)",
        "n0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, doc_id, claim FROM l)",
        "p0 AS (SELECT row_number() OVER () AS id, lang AS own, doc_id, h AS leaf, lang, pos, claim AS fold, '' AS proof FROM n0)",
    ]

    def climb(level: int, tree: str) -> None:
        parts.append(f"c{level} AS (SELECT *, count(*) OVER (PARTITION BY {tree}) AS many FROM n{level})")
        parts.append(
            f"n{level + 1} AS (SELECT {tree} AS lang, pos // 8 AS pos, CASE WHEN any_value(many) = 1 THEN any_value(h) "
            f"ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM c{level} GROUP BY {tree}, pos // 8)"
        )
        parts.append(
            f"p{level + 1} AS (SELECT p.id, any_value(p.own) AS own, any_value(p.doc_id) AS doc_id, any_value(p.leaf) AS leaf, p.lang, any_value(p.pos // 8) AS pos, "
            f"CASE WHEN any_value(many) = 1 THEN any_value(p.fold) ELSE sha256(string_agg(CASE WHEN c.pos = p.pos THEN p.fold ELSE c.h END, '' ORDER BY c.pos)) END AS fold, "
            f"any_value(p.proof) || coalesce(string_agg(CASE WHEN c.pos <> p.pos THEN c.h END, '' ORDER BY c.pos), '') AS proof "
            f"FROM p{level} p JOIN c{level} c ON p.lang IS NOT DISTINCT FROM c.lang AND p.pos // 8 = c.pos // 8 GROUP BY p.id, p.lang)"
        )

    for level in range(levels):
        climb(level, "lang")
    parts.append(f"s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM n{levels})")
    top = levels + 1
    parts.append(f"n{top} AS (SELECT 0 AS lang, pos, h FROM s)")
    parts.append(f"p{top} AS (SELECT p.id, p.own, p.doc_id, p.leaf, 0 AS lang, s.pos, p.fold, p.proof FROM p{levels} p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang)")
    for level in range(top, top + top_levels):
        climb(level, "lang")
    end = top + top_levels
    return f"""WITH {", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)}
SELECT p.doc_id, p.leaf, s.h AS subroot, n.h AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = n.h AS verified
FROM p{end} p JOIN s ON p.own IS NOT DISTINCT FROM s.lang, n{end} n"""


OP13_SQL = _merkle_sql()


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark, sf):
    docs = load(spark, sf, "documents").select(*merkle.FIELDS)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(third, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return merkle.manifest(merkle.leaves_of(docs, claimed))
