"""Filter interaction audit: what each filter removes, alone and after the others, in every order.

A relational word pipeline: words are exploded, counted by (document, word), then by document for totals and distinct
words; the flags that need no words and the labels are outer-joined, and one aggregate of conditional counts per part holds, for
each of the 32 patterns of five failing filters, the documents with that pattern, the good and the toxic ones among them. All
orders follow from those counts: a document with pattern m is removed by the first filter of an order that is in m, and
over all 120 orders each of the filters in m comes first equally often.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, NULL_ID, UPPER, table

FILTERS = "ABCDE"
SIZE = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def document_words(docs: DataFrame) -> DataFrame:
    """``doc, mark, n_words, n_distinct`` for every document, from ``doc, mark, text``.

    A document is known by its id and the hash of its text, so that rows which share an id do not mix; equal rows are
    counted once. Texts move once, words never: the rows of a document lie in one partition before it is exploded.
    """
    whole = docs.groupBy("doc", "mark").agg(F.first("text").alias("text"))
    # one leading blank gives every text, also one without words, one empty word in front
    words = F.split(F.rtrim(F.concat(F.lit(" "), "text"), F.lit(ASCII_SPACE)), r"[\x20\x09-\x0D]+")
    counted = whole.select("doc", "mark", F.explode(words).alias("word")).groupBy("doc", "mark", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("doc", "mark").agg((F.sum("n") - 1).alias("n_words"), (F.count("*") - 1).alias("n_distinct"))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, pattern, n, good, toxic``: documents by the filters they fail; bit i of the pattern is filter i of ABCDE.

    A: fewer than 200 words; B: under half of the words are distinct; C: over 3 % of the code points are A-Z; D: one of ``#$%&*|``
    occurs; E: a smaller ``doc_id`` has the same text. Rows are partial counts, to be summed by part and pattern.
    """
    text, missing = F.coalesce("text", F.lit("")), F.lit(NULL_ID)
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), missing).alias("doc"), F.xxhash64(text).alias("mark"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", UPPER, ""))
    flags = known.select(
        "doc", "mark", "part", F.sha2("text", 256).alias("digest"),
        (100 * capitals.cast("long") > 3 * F.char_length("text").cast("long")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    flags = flags.groupBy("doc", "mark", "part", "digest", "C", "D").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(says("quality"), says("toxic"))
    joined = flags.join(document_words(known), ["doc", "mark"], "full_outer").join(labelled, F.col("doc") == F.col("of"), "left")
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("C"), F.col("D")]
    bits = sum((F.when(f, 2**i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = joined.select("doc", "digest", "part", bits.alias("bits"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    # equal texts agree in all filters but E: of a group of copies only the rows of its smallest id, and those without an id, pass that
    real = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    groups = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(real).alias("least"), F.min_by("n", real).alias("at_least"), F.sum(F.when(F.col("doc") == NULL_ID, F.col("n")).otherwise(0)).alias("unnamed")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    passed = F.col("unnamed") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    split = groups.withColumn("passed", passed).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("pattern"), F.col("passed").alias("n")), F.struct((F.col("bits") + 16).alias("pattern"), (F.col("n") - F.col("passed")).alias("n")))).alias("x")
    )
    return split.select("part", "x.pattern", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters do to ``docs`` in every order: one row per part, order and step.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``. A part is a value of ``lang``; ``filter_order`` is one of
    120, ``step`` counts from 1. ``kept`` after the step, ``removed`` by it, ``redundant``: would fail the filter but are gone, ``unique_fails``:
    fail no other, ``good_lost`` and ``toxic_lost`` among the removed, ``shapley``: removed by the filter summed over all orders.

    A null text is empty and fails A only, a null ``lang`` is the part "", a null ``doc_id`` has no label and neither is nor has a smaller
    one. Repeated rows count each; rows of one id are documents of their own. An id is good or toxic if any of its labels says
    1. A text of any length counts whole. Other columns are ignored. Without documents there are no rows.
    """
    masks = range(2**SIZE)
    counts = patterns(docs, labels).groupBy("part").agg(*[F.sum(F.when(F.col("pattern") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in ("n", "good", "toxic") for m in masks])
    counts = counts.select("part", *[F.array(*[F.col(f"{c}{m}") for m in masks]).alias(c) for c in ("n", "good", "toxic")])
    orders = F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")
    rows = counts.select("*", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(SIZE))))
    bit = lambda i: F.element_at(F.array(*[F.lit(2**k) for k in range(SIZE)]), F.ascii(F.substring("filter_order", i, F.lit(1))) - 64)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(SIZE)), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(i)).otherwise(0))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("gone", before)
    total = lambda column, keep: F.aggregate(F.sequence(F.lit(0), F.lit(2**SIZE - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(keep(m), F.get(F.col(column), m)).otherwise(0))
    fails, open_ = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("gone")) == 0
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(2**SIZE - 1)), F.lit(0).cast("long"),
        lambda a, m: a + F.when(fails(m), F.get(F.col("n"), m) * (len(ORDERS) / F.bit_count(m)).cast("long")).otherwise(0),
    )
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(F.col("gone").bitwiseOR(F.col("own"))) == 0).alias("kept"),
        total("n", lambda m: fails(m) & open_(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~open_(m)).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"),
        total("good", lambda m: fails(m) & open_(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & open_(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter audit of all ``documents`` with ``labels``; rows as ``audit`` defines them."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), flags as (
  select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
         coalesce(doc_id > min(doc_id) over (partition by text), false) as e,
         coalesce(doc_id in (select doc_id from labels where quality = 1), false) as good, coalesce(doc_id in (select doc_id from labels where toxic = 1), false) as toxic
  from words
), masks as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as m, good, toxic from flags
), counts as (
  select p.part, x.m::int as m, count(masks.m) as n, count(masks.m) filter (where good) as g, count(masks.m) filter (where toxic) as t
  from (select distinct part from masks) p cross join range(32) x(m) left join masks on masks.part = p.part and masks.m = x.m group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (
  select filter_order, s::int as step, (1 << (ascii(substr(filter_order, s::int, 1)) - 65))::int as own,
         coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(substr(filter_order, i::int, 1)) - 65))), 0)::int as gone
  from orders cross join range(1, 6) r(s)
), removed as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (where m & (gone | own) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter (where m & own <> 0 and m & gone = 0), 0)::bigint as removed,
         coalesce(sum(n) filter (where m & own <> 0 and m & gone <> 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (where m = own), 0)::bigint as unique_fails,
         coalesce(sum(g) filter (where m & own <> 0 and m & gone = 0), 0)::bigint as good_lost,
         coalesce(sum(t) filter (where m & own <> 0 and m & gone = 0), 0)::bigint as toxic_lost
  from counts cross join steps group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from removed
"""
