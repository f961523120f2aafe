"""Personal data by patterns, and by what the corpus shows to reveal it.

Patterns find e-mail and IP addresses, card and phone numbers. For every term the corpus tells how much
of its use lies next to one such entity. From that follows how many of the bits that name the entity the
term gives away; a term that gives away nearly all of them, and so would reveal the entity after its
removal, is a span of its own, and is generalised to its class of words, or removed if the class gives as
much away. All of it is DataFrame work; positions come from running sums within the row.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import common

#: Lookbehinds and possessive repeats change no match; they keep the search linear on long runs. An
#: address may also begin where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind to be searched at all.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
KINDS = [*PATTERNS, "term"]
#: Words, and of those the ones that are terms: with so many letters at least.
WORD, MIN_LETTERS = r"\p{L}+", 4
TERM = rf"\p{{L}}{{{MIN_LETTERS},}}"
#: Entities and words in one pass, an entity's characters in no word.
TOKEN = "|".join([PATTERNS["email"], PATTERNS["phone"], PATTERNS["ip"], PATTERNS["card"], WORD])
#: Tokens on each side of an entity that are next to it.
NEAR = 4
#: Disclosure: so many different contexts in which term and entity meet, and the share of the entity's bits that the term gives away.
MIN_SUPPORT, MIN_DISCLOSURE = 3, 0.95
#: Occurrences of a term, at the corpus' rate, that are added to its own: few sightings are no proof.
SMOOTHING = 1.0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass Luhn's test."""
    d = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    each = F.transform(d, lambda x, i: F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", (n >= 12) & (n <= 19) & luhn(match))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str, pattern: Column) -> Column:
    """For each match: kind, text before it since the last one, and the match."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.zip_with(before, found, lambda b, m: F.struct(F.lit(kind).alias("kind"), b.alias("before"), m.alias("match")))


_EMPTY = "cast(array() as array<struct<gap:int,size:int,ok:boolean>>)"


def _pieces(text: Column, kind: str, pattern: Column) -> Column:
    """For each match of a kind: the length of the text since the last one, its own length, and whether it is valid."""
    return F.transform(_matches(text, kind, pattern), lambda x: F.struct(F.length(x["before"]).alias("gap"), F.length(x["match"]).alias("size"), F.coalesce(valid(x["kind"], x["match"]), F.lit(False)).alias("ok")))


def _placed(pieces: Column, kind: int) -> Column:
    """The valid pieces as spans (start, kind, end)."""
    ends = common.scanned(pieces, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])
    spans = F.zip_with(pieces, ends, lambda x, end: F.when(x["ok"], F.struct((end - x["size"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))))
    return F.filter(spans, lambda x: x.isNotNull())


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    return docs.select(*own, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def tokens(text: Column) -> Column:
    """Words and valid entities of a text in order, as (entity, term): one of the two is null, short words have neither.

    An entity is named by its kind and its lower-cased characters.
    """

    def named(t: Column) -> Column:
        kind = F.when(t.contains("@"), "email").when(t.startswith("+"), "phone").when(t.rlike(r"^[0-9]+\."), "ip").when(t.rlike("^[0-9]"), "card")
        entity = F.when(kind.isNotNull() & valid(kind, t), F.concat_ws(":", kind, F.lower(t)))
        return F.struct(entity.alias("entity"), F.when(kind.isNull() & (F.length(t) >= MIN_LETTERS), t).alias("term"), (kind.isNull() | entity.isNotNull()).alias("ok"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), named), lambda x: x["ok"])


def word_class(term: Column) -> Column:
    """What a term is generalised to: a word in capitals, with a capital, or another."""
    return F.when(F.upper(term) == term, "[WORD]").when(F.initcap(term) == term, "[Word]").otherwise("[word]")


def disclosure(together: Column, n: Column, chance: Column) -> Column:
    """The share of an entity's bits that a term gives away: their pointwise mutual information over the entity's information."""
    given = (together + SMOOTHING * chance) / (n + SMOOTHING)
    return 1 - F.log2(given) / F.log2(chance)


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, entity, together, n, support, disclosure, general): terms that give away an entity.

    ``n`` counts a term's occurrences outside entities, ``together`` those that have the entity among the
    tokens next to them, each once; ``support`` counts different contexts, so that copies are one. An
    entity's chance is the share of all occurrences of terms that are next to it. ``general`` is the term's
    class, or '' if the class gives the entity away, too.
    """
    at = _rows(docs, id_col, text_col).select("text")
    maybe = NEEDS["email"](F.col("text")) | NEEDS["ip"](F.col("text")) | NEEDS["card"](F.col("text")) | NEEDS["phone"](F.col("text"))
    some = common.written(at.where(maybe).select(tokens(F.col("text")).alias("t")), "entity-texts")
    with_entity = some.where(F.exists("t", lambda x: x["entity"].isNotNull()))

    def near(x: Column, i: Column) -> Column:
        first = F.greatest(i - NEAR, F.lit(0))
        around = F.slice("t", first + 1, i + NEAR + 1 - first)
        found = F.array_distinct(F.filter(F.transform(around, lambda y: y["entity"]), lambda e: e.isNotNull()))
        return F.when(x["term"].isNotNull() & (F.size(found) > 0), F.struct(x["term"].alias("term"), found.alias("entities"), F.xxhash64(around).alias("context")))

    met = with_entity.select(F.explode(F.filter(F.transform("t", near), lambda x: x.isNotNull())).alias("x")).select("x.term", "x.context", F.explode("x.entities").alias("entity"))
    contexts = met.groupBy("term", "entity", "context").agg(F.count("*").alias("n"))
    pairs = common.written(contexts.groupBy("term", "entity").agg(F.sum("n").alias("together"), F.count("*").alias("support")), "near-entities")
    own = some.select(F.explode(F.filter(F.transform("t", lambda x: x["term"]), lambda x: x.isNotNull())).alias("term"))
    used = at.where(~maybe).select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")).unionByName(own)
    # counted before the join, in which common terms would meet many entities
    used = common.written(used.groupBy("term").agg(F.count("*").alias("n")), "terms")
    total = F.broadcast(used.agg(F.sum("n").alias("total")))  # one row
    chance = pairs.groupBy("entity").agg(F.sum("together").alias("entity_n")).join(total).select("entity", (F.col("entity_n") / F.col("total")).alias("chance"))
    known = pairs.where(F.col("support") >= MIN_SUPPORT).join(used, "term").join(chance, "entity")
    known = known.withColumn("disclosure", disclosure(F.col("together"), F.col("n"), F.col("chance"))).where(F.col("disclosure") >= MIN_DISCLOSURE)
    known = common.written(known.withColumn("class", word_class(F.col("term"))), "disclosing")
    classes = F.broadcast(used.groupBy(word_class(F.col("term")).alias("class")).agg(F.sum("n").alias("class_n")))  # three rows
    by_class = pairs.join(known.select("entity").distinct(), "entity", "left_semi").groupBy(word_class(F.col("term")).alias("class"), "entity").agg(F.sum("together").alias("class_together"))
    known = known.join(by_class, ["class", "entity"]).join(classes, "class")
    hidden = disclosure(F.col("class_together"), F.col("class_n"), F.col("chance")) < MIN_DISCLOSURE
    return known.select("term", "entity", "together", "n", "support", "disclosure", F.when(hidden, F.col("class")).otherwise("").alias("general"))


def _spanned(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Every row (and with ``carry`` all of it as ``row``) with its spans and what its terms are generalised to."""
    found = disclosing_terms(docs, id_col, text_col).groupBy("term").agg(F.min("general").alias("general"))
    found = common.written(found, "disclosing-terms")
    at = _rows(docs, id_col, text_col, carry).withColumn("h", F.xxhash64("text"))
    has = at.select("doc_id", "h", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term")).join(common.maybe_broadcast(found), "term")
    # rows that repeat both id and text have the same terms
    has = has.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "general")))).alias("labels"))
    has = common.maybe_broadcast(common.written(has, "term-docs"))
    at = at.join(has, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    keep = ["row"] * carry + ["doc_id", "labels"] + ["text"] * carry
    none = F.expr(_EMPTY)
    own = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("labels"), "|"), F.lit(r")(?!\p{L})"))
    each = [F.when(NEEDS[k](F.col("text")), _pieces(F.col("text"), k, F.lit(p))).otherwise(none).alias(k) for k, p in PATTERNS.items()]
    at = at.select(*keep, *each, F.when(F.col("labels").isNotNull(), _pieces(F.col("text"), "term", own)).otherwise(none).alias("term"))
    at = at.select(*keep, F.array_sort(F.concat(*(_placed(F.col(k), i) for i, k in enumerate(PATTERNS)))).alias("base"), _placed(F.col("term"), len(PATTERNS)).alias("terms"))
    apart = F.filter("terms", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    spans = F.when(F.size("terms") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", apart)))
    return at.select(*keep, spans.alias("spans"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: all spans (start, kind as its number in KINDS, end), in code points, sorted.

    Terms lie where no pattern's span does. A null text is empty; rows that repeat have spans each; an id
    may be null; an empty table gives no rows.
    """
    return _spanned(docs, id_col, text_col).select("doc_id", "spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def _is_kind(number: int, span: Column) -> Column:
    return span["kind"] == number


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the patterns' spans and all spans as text, of what ``spans()`` returns."""
    base = F.filter("spans", lambda x: x["kind"] < len(PATTERNS))
    counts = [F.size(F.filter("spans", partial(_is_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` generalised: patterns' spans to their kind in brackets, terms to their
    class of words, or removed where that is not enough. Of overlapping spans the first counts; null texts stay null."""
    at = _spanned(docs, id_col, text_col, carry=True)
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    part = lambda a, b: F.substring(F.col("text"), a + 1, b - a)

    def step(acc: Column, x: Column) -> Column:
        label = F.when(x["kind"] == len(PATTERNS), F.col("labels")[part(x["start"], x["end"])]).otherwise(F.concat(F.lit("["), F.upper(name(x)), F.lit("]")))
        longer = F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(part(acc["at"], x["start"]), label)).alias("parts"))
        return F.when(x["start"] >= acc["at"], longer).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("spans") == 0, F.col(f"row.`{text_col}`")).otherwise(F.aggregate("spans", start, step, end))
    return at.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
