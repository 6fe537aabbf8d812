"""Licence scan by sentence rules.

A text is cut into sentences, wrapped lines joined; each is normalised and mapped to the identifier of a known licence sentence. The sequence of
identifiers is matched against ordered licence rules: the first rules are the most specific, and what a rule has used up
is not seen by later ones. Built-in expressions only, on texts that hold a licence word at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let

# what may stand between a licence's name and its version: no other licence's name
_GAP = r"(?:(?!\blicense\b).)*?"
_LATER = r"(?:,? of the license)?,? ?(?:\(?(?:or|and)\b.{0,40}?\blater\b)"
_VERSION = r"(?:version |v\.? ?)([0-9]+(?:\.[0-9]+)*)"

# identifier of a sentence, pattern of its normalised form, and a word that no match is without; groups carry versions into
# the identifier
SENTENCES = (
    ("spdx:$1", r"\bspdx-license-identifier: ([a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)", "spdx"),
    ("lgpl-$1+", rf"\bgnu (?:lesser|library) general public license\b{_GAP}\b{_VERSION}{_LATER}", "licen[cs]e"),
    ("agpl-$1+", rf"\bgnu affero general public license\b{_GAP}\b{_VERSION}{_LATER}", "licen[cs]e"),
    ("gpl-$1+", rf"\bgnu general public license\b{_GAP}\b{_VERSION}{_LATER}", "licen[cs]e"),
    ("lgpl-$1", rf"\bgnu (?:lesser|library) general public license\b{_GAP}\b{_VERSION}", "licen[cs]e"),
    ("agpl-$1", rf"\bgnu affero general public license\b{_GAP}\b{_VERSION}", "licen[cs]e"),
    ("gpl-$1", rf"\bgnu general public license\b{_GAP}\b{_VERSION}", "licen[cs]e"),
    ("lgpl-any", r"\bgnu (?:lesser|library) general public license\b", "licen[cs]e"),
    ("agpl-any", r"\bgnu affero general public license\b", "licen[cs]e"),
    ("gpl-any", r"\bgnu general public license\b", "licen[cs]e"),
    ("apache-$1", rf"\bapache license\b{_GAP}\b{_VERSION}", "licen[cs]e"),
    ("apache-$1", r"\bapache license ([0-9.]*[0-9])", "licen[cs]e"),
    ("mpl-$1", r"\bmozilla public license\b(?:(?!\blicense\b).){0,40}?([0-9]+(?:\.[0-9]+)*)", "licen[cs]e"),
    ("cc-$1-$2", r"\b(?:cc|creative commons) (by(?:-nc)?(?:-sa|-nd)?) ([0-9.]*[0-9])", r"\bcc\b|creative"),
    ("cc0", r"\bcc0\b|\bcreative commons zero\b", r"\bcc0\b|creative"),
    ("mit-grant", r"\bpermission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission"),
    ("mit-notice", r"\bthe above copyright notice and this permission notice shall be included in all copies", "permission"),
    ("isc-grant", r"\bpermission to use, copy, modify,? and/?o?r? distribute this software for any purpose", "permission"),
    ("bsd-grant", r"\bredistribution and use in source and binary forms, with or without modification, are permitted", "redistribution"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice", "redistribution"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice", "redistribution"),
    ("bsd-endorse", r"neither the name of .{1,300}? may be used to endorse or promote products", "endorse"),
    ("mit-name", r"\bmit license\b", "licen[cs]e"),
    ("bsd-name", r"\b(?:new |modified |simplified )?bsd license\b", "licen[cs]e"),
    ("public-domain", r"\bpublic domain\b", "domain"),
    ("as-is", r"provided .?as is.?,? without (?:any )?(?:express or implied )?warrant", "warrant"),
    ("copyright", r"^(?:\(c\) )?copyright\b", "copyright"),
    ("unknown-licence", r"\blicensed? under\b|\breleased under\b", "licen[cs]e|released"),
)
# single words without which no sentence is known; lines may break anywhere else
TRIGGER = "(?i)" + "|".join(dict.fromkeys(word for _, _, word in SENTENCES))
# a line of its own within a sentence adds no such identifier to those of the sentence
_WEAK = ("gpl-any", "lgpl-any", "agpl-any", "copyright", "unknown-licence", "as-is")

# licence -> pattern over the sequence ";id;id;...;"; the order is the order of matching, None takes the name from the text
RULES = (
    (None, r"(?<=;)spdx:([^;]+);"),
    ("MIT", r"(?<=;)mit-grant;(?:copyright;)*mit-notice;(?:as-is;)?"),
    ("BSD-3-Clause", r"(?<=;)bsd-grant;bsd-source;bsd-binary;bsd-endorse;(?:as-is;)?"),
    ("BSD-2-Clause", r"(?<=;)bsd-grant;bsd-source;bsd-binary;(?:as-is;)?"),
    ("ISC", r"(?<=;)isc-grant;(?:as-is;)?"),
    (None, r"(?<=;)((?:gpl|lgpl|agpl|apache|mpl|cc)-[^;]+);"),
    (None, r"(?<=;)(cc0);"),
    ("MIT", r"(?<=;)mit-name;"),
    ("BSD", r"(?<=;)bsd-name;"),
    ("public-domain", r"(?<=;)public-domain;"),
    ("unknown", r"(?<=;)unknown-licence;"),
)


def sentences(text: Column) -> Column:
    """Pieces between blank lines, before SPDX lines and after full stops that end a sentence, without comment marks.

    Wrapped lines stay together, with their line ends.
    """
    plain = F.regexp_replace(text, r"(?m)^[ \t]*+(?:(?:[/*#;%|]++|<!--+|--+|- )[ \t]*+)++|[ \t]*+(?:\*++/|--+>)[ \t]*+$", "")
    return F.split(plain, r"\R(?:[ \t]*+\R)++\s*+|\R(?=[^\r\n]{0,20}(?i:spdx-license))|(?<=[.!?])(?<!\b[vV]\.)\s+")


def normalise(sentence: Column) -> Column:
    """Lower case, one spelling, single spaces, no comment marks at the ends."""
    plain = F.lower(sentence)
    for pattern, to in ((r"^[\s/*#;%<!-]+|[\s/*#<>;-]+$", ""), ("licence", "license"), (r"\s+", " "), (r"[\"'`]", ""), (r"[.!?,]+$", "")):
        plain = F.regexp_replace(plain, pattern, to)
    return plain


def sentence_id(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if it is not a known one."""
    def name(identifier: str, pattern: str) -> Column:
        parts = F.lit(identifier)
        for group in range(1, identifier.count("$") + 1):
            parts = F.replace(parts, F.lit(f"${group}"), F.regexp_extract(sentence, pattern, group))
        return parts

    first, *rest = SENTENCES
    return reduce(lambda case, s: case.when(sentence.rlike(s[1]), name(*s[:2])), rest, F.when(sentence.rlike(first[1]), name(*first[:2])))


def sentence_ids(sentence: Column) -> Column:
    """Identifier of a sentence, and those of its lines that name other licences. Empty if it is not a known one."""

    def lines(whole: Column) -> Column:
        each = F.transform(F.filter(F.split(sentence, r"\R+"), lambda line: line.rlike(TRIGGER)), lambda line: sentence_id(normalise(line)))
        same = lambda i: (i == whole) | (F.concat(i, F.lit("+")) == whole) | i.isin(*_WEAK)
        return F.concat(F.array(whole), F.filter(each, lambda i: i.isNotNull() & ~same(i)))

    single = lambda whole: F.when(sentence.rlike(r"\R"), lines(whole)).otherwise(F.array(whole))
    none = F.array().cast("array<string>")
    return let(sentence_id(normalise(sentence)), lambda whole: F.when(whole.isNull(), none).otherwise(single(whole)))


def _apply_rules(sequence: Column) -> Column:
    """Licences of an identifier sequence, in the order of the rules."""
    state = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).cast("string").alias("name"), F.lit(p).alias("pattern")) for name, p in RULES])

    def apply(state: Column, rule: Column) -> Column:
        group = F.when(rule["name"].isNull(), F.lit(1)).otherwise(F.lit(0))
        hits = F.regexp_extract_all(state["rest"], rule["pattern"], group)
        names = F.transform(hits, lambda hit: F.coalesce(rule["name"], hit))
        rest = F.when(F.size(hits) > 0, F.regexp_replace(state["rest"], rule["pattern"], F.lit("*;"))).otherwise(state["rest"])
        return F.struct(rest.alias("rest"), F.concat(state["found"], names).alias("found"))

    def specific(found: Column) -> Column:
        family = lambda i: F.substring_index(i, "-", 1)
        versions = F.transform(F.filter(found, lambda i: ~i.endswith("-any")), family)
        return F.filter(found, lambda i: ~(i.endswith("-any") & F.array_contains(versions, family(i))))

    return F.aggregate(rules, state, apply, lambda state: specific(F.array_distinct(state["found"])))


def scan_licences(docs: DataFrame) -> DataFrame:
    """All columns of ``docs(text, ...)`` with ``sentence_ids`` (in text order) and ``licences`` (in rule order).

    Both are empty for texts without a known sentence, null or empty. Columns of these names are replaced. Repeated rows
    are scanned one by one; an empty table stays empty. Texts of any length are read whole.
    """
    docs = docs.drop("sentence_ids", "licences")
    none = F.array().cast("array<string>")
    candidates = F.filter(sentences(F.col("text")), lambda s: s.rlike(TRIGGER))
    ids = F.flatten(F.transform(candidates, sentence_ids))
    marked = docs.withColumn("sentence_ids", F.when(F.col("text").rlike(TRIGGER), ids).otherwise(none))
    sequence = F.concat(F.lit(";"), F.array_join("sentence_ids", ";"), F.lit(";"))
    licences = F.when(F.size("sentence_ids") > 0, _apply_rules(sequence)).otherwise(none)
    return marked.withColumn("licences", licences)
