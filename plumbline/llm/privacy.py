"""Personal data: base patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Their values are the protected entities.
How strongly a term reveals an entity is estimated over the corpus, with distinct sentences as the unit, so that copied
text counts once: ``PMI = ln(N n_te / (n_t n_e))`` against the entity's information ``IC = ln(N / n_e)``. The quotient is
the share of the information that the term discloses. Terms at or above ``generalise`` are generalised (a number to
``[NUMBER]``, a word to ``[WORD]``), those at or above ``remove`` are removed, in the texts that hold the entity.

Variants of one sentence are not independent evidence. The sentences of a pair are therefore sorted into families: up to
``LEADERS`` of them, drawn by hash, lead one each, and a sentence belongs to the first leader with which it has ``ALIKE`` of
the words of the longer one in common, or to itself. A pair needs an effective number of families, ``(sum c)**2 / sum c**2``,
of at least two. Words that independent sentences share do not make them one family. Only a family of more than half of the
sentences can bring the number below two, so one of its sentences is a leader but for a chance of ``2**-LEADERS``.

Built-in expressions only. The patterns equal the plain ones they stand for, but never try a run of characters twice, so
they stay linear on long texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let, offsets
from plumbline.llm.tokens import row_count, settled

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
GENERALISE = 0.6
REMOVE = 0.95
FAMILIES = 2.0
LEADERS = 16
ALIKE = 0.8
SKETCH = 64  # words, least hashes first, by which longer sentences are compared
BROADCAST_ROWS = 1 << 17

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
# texts that do not contain these hold no match
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SENTENCE_END = r"(?<=[.!?])\s+|\R+"
_WORD = r"[\p{L}\p{N}]+"
_SPAN = "array<struct<start: bigint, stop: bigint, kind: string, value: string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda n, v: n + F.coalesce(v, F.lit(0))) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """The rule that a match of the pattern must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """Matches with their code point spans: the pieces between the matches give the places."""

    def spans(pieces: Column, found: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"), m.alias("value")))
        starts = offsets(F.transform(sizes, lambda s: s["gap"] + s["size"]))
        place = lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value"))
        return let(sizes, lambda s: F.zip_with(s, starts, place))

    return let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: spans(pieces, found)))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and start."""
    none = F.array().cast(_SPAN)
    parts = []
    for kind in KINDS:
        valid = F.filter(match_spans(text, PATTERNS[kind], kind), lambda s: is_valid(kind, s["value"]))
        parts.append(F.when(text.rlike(_HINTS[kind]), valid.cast(_SPAN)).otherwise(none))
    return F.concat(*parts)


def _entities(text: Column) -> Column:
    """Distinct values of the base kinds in a sentence."""
    none = F.array().cast("array<string>")
    parts = []
    for kind in KINDS:
        found = F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda v: is_valid(kind, v))
        parts.append(F.when(text.rlike(_HINTS[kind]), found).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def _masked(text: Column) -> Column:
    """The text with everything like an entity blanked out; phone numbers before the runs of digits within them."""
    return reduce(lambda t, kind: F.regexp_replace(t, PATTERNS[kind], " "), ("email", "phone", "ip", "card"), text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def _alike(a: Column, b: Column) -> Column:
    """Whether two sentences have most of their words in common."""
    return F.size(F.array_intersect(a, b)) >= F.greatest(F.size(a), F.size(b)) * ALIKE


def _families(rows: DataFrame) -> DataFrame:
    """``entity, term, n_te, squares`` of ``rows(entity, term, sentence, sketch)``: sentences, and squares of family sizes."""
    pair = ["entity", "term"]
    place = F.row_number().over(Window.partitionBy(*pair).orderBy("sentence"))
    leaders = rows.withColumn("place", place).where(F.col("place") <= LEADERS)
    leaders = leaders.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("place", "sketch"))).alias("leaders"))
    leading = F.array_position(F.transform("leaders", lambda l: _alike(l["sketch"], F.col("sketch"))), F.lit(True))
    sizes = rows.join(leaders, pair).groupBy(*pair, leading.alias("family")).agg(F.count(F.lit(1)).alias("c"))
    alone = F.col("family") == 0  # as many families as sentences
    return sizes.groupBy(*pair).agg(F.sum("c").alias("n_te"), F.sum(F.when(alone, F.col("c")).otherwise(F.col("c") * F.col("c"))).alias("squares"))


def _near(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if row_count(df) <= BROADCAST_ROWS else df


def disclosing_terms(
    texts: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, families: float = FAMILIES
) -> DataFrame:
    """``entity, term, disclosure, action`` of the terms of ``texts(text)`` that reveal an entity."""
    any_hint = reduce(lambda a, b: a | b, [F.col("text").rlike(_HINTS[k]) for k in KINDS])
    sentences = texts.where(any_hint).select(F.explode(F.split("text", _SENTENCE_END)).alias("text"))
    holding = sentences.where(any_hint).distinct().select(
        F.xxhash64("text").alias("sentence"), _entities(F.col("text")).alias("entities"), _terms(_masked(F.col("text"))).alias("terms")
    )
    holding = settled(holding.where(F.size("entities") > 0), "sentences")
    sketch = F.slice(F.sort_array(F.transform("terms", lambda t: F.xxhash64(t))), 1, SKETCH)
    entities = holding.select("sentence", F.explode("entities").alias("entity"), "terms", sketch.alias("sketch"))
    per_entity = holding.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # fewer sentences than families cannot be enough
    often = per_entity.where(F.col("n_e") >= families).select("entity")
    terms = entities.join(often, "entity").select("entity", "sentence", "sketch", F.explode("terms").alias("term"))
    counted = terms.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= families)
    rows = settled(terms.join(counted.select("entity", "term"), ["entity", "term"]), "evidence")
    pairs = _families(rows)
    pairs = settled(pairs.where(F.col("n_te") * F.col("n_te") >= F.col("squares") * families).select("entity", "term", "n_te"), "pairs")
    every = texts.select(F.explode(F.split("text", _SENTENCE_END)).alias("text")).where("text != ''")
    total = every.agg(F.count_distinct(F.xxhash64("text"))).first()[0] if not pairs.isEmpty() else 0
    wanted = pairs.select("term").distinct()
    known = F.when(any_hint, _masked(F.col("text"))).otherwise(F.col("text"))
    seen = every.select(F.xxhash64("text").alias("sentence"), F.explode(_terms(known)).alias("term")) if total else None
    if seen is None:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action"))
    n = F.lit(float(total))
    share = lambda held: F.log(n * F.col("n_te") / (held * F.col("n_e"))) / F.log(n / F.col("n_e"))
    weighed = settled(pairs.join(per_entity.where(F.col("n_e") < total), "entity"), "weighed")
    # a sketch of the sentence counts rules out the many terms that stand in far too many; the rest is counted exactly
    about = seen.join(_near(wanted), "term", "left_semi").groupBy("term").agg(F.approx_count_distinct("sentence", 0.05).alias("about"))
    likely = weighed.join(about, "term").where(share(F.greatest(F.col("about") / 2, F.col("n_te"))) >= generalise)
    likely = settled(likely.select("term").distinct(), "likely")
    per_term = seen.join(_near(likely), "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    weighed = weighed.join(per_term, "term").withColumn("disclosure", share(F.col("n_t"))).where(F.col("disclosure") >= generalise)
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    return settled(weighed.select("entity", "term", "disclosure", action.alias("action")), "disclosing")


def _term_spans(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """``key, extra``: the spans of revealing terms, of each text that holds their entity."""
    entities = docs.select("key", F.explode("spans").alias("s")).select("key", F.col("s.value").alias("entity")).distinct()
    told = entities.join(_near(revealing.select("entity", "term", "action")), "entity").groupBy("key", "term").agg(F.max("action").alias("action"))
    told = settled(told, "told")
    texts = docs.join(_near(told.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    words = texts.select("key", "spans", F.explode(match_spans(F.col("text"), _WORD, TERM)).alias("w"))
    outside = ~F.exists("spans", lambda s: (s["start"] < F.col("w.stop")) & (F.col("w.start") < s["stop"]))
    words = words.where(outside).select("key", F.lower("w.value").alias("term"), "w")
    found = words.join(told, ["key", "term"]).select("key", F.struct("w.start", "w.stop", F.concat(F.lit("term_"), "action").alias("kind"), "w.value").alias("w"))
    return found.groupBy("key").agg(F.array_sort(F.collect_list("w")).cast(_SPAN).alias("extra"))


def find_personal_data(
    docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, families: float = FAMILIES
) -> DataFrame:
    """All columns of ``docs(text, ...)`` with ``spans``: array of ``start, stop, kind, value`` in code points, stop excluded.

    Base spans come first, by kind and start, then those of revealing terms (``term_generalise``, ``term_remove``) by start.
    Null and empty texts have no spans; repeated rows have the same; an empty table stays empty. A column named ``spans``
    is replaced.
    """
    columns = [c for c in docs.columns if c != "spans"]
    found = docs.select(*columns, base_spans(F.coalesce(F.col("text"), F.lit(""))).alias("spans"))
    revealing = disclosing_terms(docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL"), generalise, remove, families)
    if revealing.isEmpty():
        return found
    keyed = found.withColumn("_key", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    extra = settled(_term_spans(keyed.where(F.size("spans") > 0).select(F.col("_key").alias("key"), "text", "spans"), revealing), "extra")
    spans = F.concat("spans", F.coalesce("_extra", F.array().cast(_SPAN)))
    return keyed.join(_near(extra.toDF("_key", "_extra")), "_key", "left").select(*columns, spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; both actions on terms print as ``term``."""
    kind = lambda s: F.when(s["kind"].startswith("term_"), F.lit(TERM)).otherwise(s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by the name of its kind; overlapping spans count as the first of them."""
    ordered = F.array_sort(spans)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    term = lambda s: F.when(s["kind"] == "term_remove", "").when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
    mark = lambda s: F.when(s["kind"].startswith("term_"), term(s)).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(between, mark(s)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, state, step, rest)).otherwise(text)
