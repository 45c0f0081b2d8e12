"""Information-theoretic sanitisation of personal data; DataFrame functions only.

Patterns find the protected entities of a text: e-mail addresses, IP addresses, card and telephone numbers. The corpus
then tells which terms reveal them. For a term t that stands in a text with entity e, outside of the patterns' matches
and anywhere in the text, the share of e's information that t discloses is log2(P(e | t) / P(e)) / -log2 P(e), with
P(e | t) the share of the texts with t that hold e. Where it reaches DISCLOSURE, the term is generalised in every text
that holds the entity. An entity in MIN_TEXTS different texts or more needs that many with the term. For a rarer one the
term must stand in all of its texts, and P(e | t) is smoothed as if there were one more text with t and without e, so a
term that only the one text of its entity has is generalised where there are 1,024 different texts or more.

Limit of the method: a text that holds a revealing term but not the entity keeps the term.

The patterns match what the plain forms in the comments match, written so that no text makes them backtrack far or
recurse: possessive repeats, and starts only where a run of characters starts or the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join, table

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: a match of the plain form is a whole run of digits with single separators
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[^\p{L}\p{N}]+"
#: The least length of a term.
SHORTEST = 3
MIN_TEXTS = 3
DISCLOSURE = 0.9


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text, whose last is the check digit, pass Luhn's test."""
    d = digits(text)

    def add(total, i):
        v = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = 2 * v - F.when(v > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return luhn(text)
    if kind == "phone":
        return F.length(digits(text)).between(10, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Arrays are walked in pieces of so many elements: adding to an array copies it.
PIECE = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walked(items: Column, begin: Column, step, kind: str) -> Column:
    """The elements that step appends, in order: step(at, item) gives (the next at, the elements for item)."""
    n = F.size(items)
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PIECE)), lambda i: F.slice(items, i, F.lit(PIECE)))).otherwise(F.array())
    pack = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    none = F.array().cast(kind)

    def one(acc, x):
        at, more = step(acc["at"], x)
        return pack(at, F.concat(acc["out"], more))

    def piece(acc, p):
        return let(F.aggregate(p, pack(acc["at"], none), one), lambda r: pack(r["at"], F.concat(acc["out"], F.array(r["out"]))))

    return F.aggregate(pieces, pack(begin, F.array().cast(f"array<{kind}>")), piece, lambda acc: F.flatten(acc["out"]))


def spans_of(kind: str, text: Column) -> Column:
    """The valid spans of a kind: positions from the lengths of the matches and of what stands between them."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(at, x):
        start = at + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return end, F.when(valid(kind, x["m"]), F.array(span)).otherwise(F.array().cast(SPAN))

    none = F.array().cast(SPAN)
    zipped = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    found = let(zipped, lambda z: walked(z, F.lit(0), step, SPAN))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[spans_of(k, text) for k in KINDS[:4]]))


def entity(span: Column) -> Column:
    """An entity's name: its kind, and its value in lower case or its digits alone."""
    plain = F.when(span["kind"] < 2, F.lower(span["value"])).otherwise(digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), plain)


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), TERM, -1), lambda t: F.length(t) >= SHORTEST))


def replaced(text: Column, spans: Column, put) -> Column:
    """text with put(span, at) in the place of each span; at: where the text up to the spans before it ends."""
    # a piece of spans looks at its stretch of text alone, as finding a character takes a walk from the start
    n = F.size(spans)
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PIECE)), lambda i: F.slice(spans, i, F.lit(PIECE)))).otherwise(F.array())
    pack = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    no_text = F.array().cast("array<string>")

    def piece(acc, p):
        here = let(F.array_max(F.transform(p, lambda s: s["end"])), lambda end: F.struct(acc["at"].alias("low"), F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), end - acc["at"])).alias("part")))

        def one(part):
            def step(inner, s):
                kept = F.substring(part["part"], inner["at"] - part["low"] + 1, F.greatest(F.lit(0), s["start"] - inner["at"]))
                return pack(F.greatest(inner["at"], s["end"]), F.concat(inner["out"], F.array(kept, put(s, inner["at"]))))

            return F.aggregate(p, pack(acc["at"], no_text), step)

        return let(let(here, one), lambda r: pack(r["at"], F.concat(acc["out"], F.array(F.array_join(r["out"], "")))))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(pieces, pack(F.lit(0), no_text), piece, rest)


def outside(text: Column, spans: Column) -> Column:
    """text with spaces in the places of its spans."""
    return replaced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"]))))


def texts_with(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, n_t): how many different texts hold each candidate. k copies of a text count for one k-th each, so that tasks
    can add up the terms of their texts before the shuffle."""
    copies = texts.groupBy("th").agg(F.count("*").alias("k")).where("k > 1")
    whole = texts.join(copies, "th", "left").select(F.explode(terms(F.col("text"))).alias("t"), (1 / F.coalesce("k", F.lit(1))).alias("part"))
    return materialise(whole.groupBy("t").agg(F.round(F.sum("part")).alias("n_t")).join(candidates, "t"))


def revealing(texts: DataFrame) -> DataFrame:
    """(th, terms): for each text, by its hash, the terms that disclose an entity it holds. texts: th, text.

    Entities that stand in the same texts are one class, so a text that lists thousands of them costs no more than one.
    """
    spanned = texts.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    held = spanned.select("th", F.array_distinct(F.transform("spans", entity)).alias("es"), terms(outside(F.col("text"), F.col("spans"))).alias("ts"))
    held = materialise(held.dropDuplicates(["th"]))
    entities = held.select("th", F.explode("es").alias("e"))
    of_class = ["n_e", "x", "y"]
    sets = entities.groupBy("e").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64(F.lit(1), "th")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "th")).alias("y"))
    classes = materialise(skew_join(entities, sets, ["e"]).select("th", *of_class).distinct())
    n = float(max(texts.select("th").distinct().count(), 1))
    p_e = F.col("n_e") / F.lit(n)
    more = F.when(F.col("n_both") < MIN_TEXTS, 1).otherwise(0)
    disclosed = lambda texts_with_t: F.log2(F.col("n_both") / (texts_with_t + more) / p_e) / F.nullif(-F.log2(p_e), F.lit(0.0))
    # a term stands in at least as many texts as it stands with entities in: one that discloses too little even if there
    # are no others, and all texts of the entity hold it, needs no pairs and no count over the corpus
    named = held.select("th", F.explode("ts").alias("t"))
    n_near = named.groupBy("t").agg(F.count("*").alias("n_near"))
    most = F.col("n_e") * F.pow(p_e, F.lit(DISCLOSURE - 1)) * (1 + 1e-9)
    widest = classes.agg(F.coalesce(F.max(most), F.lit(0.0))).first()[0]
    named = named.join(n_near.where(F.col("n_near") <= widest), "t")
    together = classes.join(named, "th").where(F.col("n_near") <= most).groupBy(*of_class, "t").agg(F.count("*").alias("n_both"), F.first("n_near").alias("n_near"))
    possible = together.where((F.col("n_both") >= F.least(F.lit(MIN_TEXTS), "n_e")) & (disclosed(F.col("n_near")) >= DISCLOSURE))
    possible = materialise(possible)
    candidates = possible.select("t").distinct()
    n_t = texts_with(candidates, texts)
    strong = possible.join(n_t, "t").where(disclosed(F.col("n_t")) >= DISCLOSURE).select(*of_class, "t")
    holds = named.select("th", "t")
    return materialise(classes.join(strong, of_class).join(holds, ["th", "t"]).groupBy("th").agg(F.sort_array(F.collect_set("t")).alias("terms")))


def term_spans(text: Column, wanted: Column) -> Column:
    """Spans of the wanted terms in text, in which terms are runs of letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))

    def step(at, x):
        end = at + F.length(x)
        span = F.struct(at.alias("start"), F.lit(4).alias("kind"), end.alias("end"), x.alias("value"))
        return end, F.when(F.array_contains(wanted, F.lower(x)), F.array(span)).otherwise(F.array().cast(SPAN))

    return let(runs, lambda r: walked(r, F.lit(0), step, SPAN))


def find(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, base, spans): each document with its base spans, and with all spans, terms included.

    Spans are (start, kind, end, value) in code points, by start and then kind. A null text is an empty one. Terms are
    what is left of runs of letters and digits beside the base spans. Texts that are equal count once in the corpus
    statistics, so copies don't make a term look revealing. Documents of any columns, nulls and repeated rows come
    through as they are.
    """
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.md5("text"))
    joined = rows.join(revealing(rows.select("th", "text")), "th", "left")
    found = joined.withColumn("base", base_spans(F.col("text")))
    more = F.when(F.col("terms").isNotNull(), let(outside(F.col("text"), F.col("base")), lambda t: term_spans(t, F.col("terms")))).otherwise(F.array().cast(SPAN))
    return found.select("row", "text", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans; nulls and ties as in find."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(documents, text_col).select(F.col(f"row.{id_col}").alias(id_col), *[n(k) for k in range(5)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitise(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents, with the same columns, in which every span of find is generalised to its kind, as in ``[EMAIL]``.
    Overlapping spans are replaced as one, by the first's kind. n_chars, if there is one, counts the new text."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    tag = lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.element_at(tags, s["kind"] + 1))
    new = F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"), tag)).otherwise(F.col(f"row.{text_col}"))
    done = find(documents, text_col).withColumn("new", new)
    of = {text_col: F.col("new"), "n_chars": F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in documents.columns else None}
    return done.select(*[(of[c] if c in of else F.col("row").getField(c)).cast(documents.schema[c].dataType).alias(c) for c in documents.columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
