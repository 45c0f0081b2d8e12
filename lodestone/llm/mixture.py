"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Within a source all documents have the same expected number of copies e = target / size of the source, so the prefix
sum of expected copies at a document is e times its rank. Documents are ranked by size class, then by a hash, which
keeps the words taken close to the target. Ranks are made of two parts, so that no task needs a whole source: a window
within (source, size class, salt), and an offset from the counts of these groups. With one random offset u for each
source, a document is emitted once for every integer that e * rank + u crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table, uniform

#: Weights of the sources in the order of their names, repeating; the mix's share of all words; the most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SALTS = 64
GROUP = ["s", "no_s", "class", "salt"]


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(groups: DataFrame) -> DataFrame:
    """(s, no_s, source_size, target, u) for each source from the groups' word sums.

    The fixed point of sharing by weight with caps is a level: each source gets the lesser of its cap and weight times
    level. In the order of cap / weight, the level is found at the first source that its share does not overfill.
    """
    named = Window.orderBy("no_s", "s")
    sizes = groups.groupBy("s", "no_s").agg(F.sum("words").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(w).cast("double") for w in WEIGHTS]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size").cast("double") * MOST)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "no_s", "s")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    share = (F.sum("source_size").over(everything).cast("double") * SHARE - before) / after
    leveled = weighed.withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("c"), "share"))).over(everything)["share"]
    target = F.least("cap", F.col("weight") * level)
    return leveled.select("s", "no_s", "source_size", target.alias("target"), uniform("offset", "s", "no_s").alias("u"))


def mix(documents: DataFrame, rows: Column, size: Column, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, size, source_size, target, copies, taken): rows of documents with the copies the mix takes of each.

    documents is read twice. size: words of a row (null: 0). Sources rank by code point, null is a source of its own
    and last. A document without words has 0 words to take, whatever its copies. Rows that are equal in all columns are
    ranked one after the other; which of them gets a copy makes no difference. A null doc_id counts as an empty one.
    Nothing comes of an empty table.
    """
    h = uniform("mix", doc_id)
    size = F.coalesce(size, F.lit(0)).cast("long")
    base = documents.select(rows.alias("row"), size.alias("size"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.col(source).isNull().alias("no_s"), h.alias("h"), F.col(doc_id).alias("k"))
    base = base.withColumn("class", F.floor(F.sqrt("size"))).withColumn("salt", F.floor(F.col("h") * SALTS))
    groups = materialise(base.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    order = Window.partitionBy("s", "no_s").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(targets(groups), ["s", "no_s"]).select(*GROUP, "before", "source_size", "target", "u")
    within = Window.partitionBy(*GROUP).orderBy("h", "k", "size")
    ranked = base.join(offsets, GROUP).withColumn("rank", F.col("before") + F.row_number().over(within))
    e = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    copies = F.least(F.lit(MOST).cast("long"), F.floor(e * F.col("rank") + F.col("u")) - F.floor(e * (F.col("rank") - 1) + F.col("u")))
    return ranked.withColumn("copies", copies).select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """The documents of the mix, as often as it takes them, with the columns they had."""
    mixed = mix(documents, F.struct("*"), word_count()).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def op2_mixture(spark, sf_dir: str) -> DataFrame:
    light = materialise(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")))
    return mix(light, F.col("doc_id"), F.col("size")).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


_H = "CAST('0x' || substr(md5('{0}:' || {1}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0"
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS no_s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    {_H.format("mix", "coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
e AS (SELECT *, floor(sqrt(size)) AS class, floor(h * 64) AS salt FROM d),
s1 AS (SELECT s, no_s, sum(size)::BIGINT AS source_size FROM e GROUP BY ALL),
s2 AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY no_s, s) - 1) % 3 + 1)] AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, no_s, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, no_s, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s2),
s4 AS (SELECT s, no_s, source_size, least(cap, weight * (SELECT share FROM s3 WHERE share <= cap / weight ORDER BY cap / weight, share LIMIT 1)) AS target,
    {_H.format("offset", "s || ':' || no_s")} AS u FROM s3),
r AS (SELECT e.*, row_number() OVER (PARTITION BY s, no_s ORDER BY class, salt, h, doc_id, size) AS rk FROM e),
c AS (SELECT r.doc_id, r.size, s4.source_size, s4.target,
    least(2, (floor(coalesce(target / nullif(source_size, 0), 0) * rk + u) - floor(coalesce(target / nullif(source_size, 0), 0) * (rk - 1) + u)))::BIGINT AS copies
    FROM r JOIN s4 USING (s, no_s))
SELECT doc_id, size::BIGINT AS size, source_size, target, copies, copies * size::BIGINT AS taken FROM c
"""
