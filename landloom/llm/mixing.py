"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies. Its whole part is taken as it
is; the fractional parts meet in pairs that pass word mass to one another, in a random direction of
fair odds, until one of the two is integral. Passing words rather than copies keeps a source's words
exactly at its target until one document per source is left to round. Groups of about ``fan`` documents
are folded at once and leave one residual each; residuals are combined level by level in a reduction
tree, so a source with a third of all rows is spread over all tasks.

DataFrame functions only; nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

UNIT = "uid long, s double, x double, doc_id long, size long, n long, source_size long, target double, base long"
#: Equal rows that one task writes out at a time.
CHUNK = 4096

#: One step of the fold. ``acc.cur`` is the fractional unit in hand, ``e`` the next one; ``d_in`` is the
#: word mass that ``cur`` can take from ``e``, ``d_out`` what it can give. Either move makes one of
#: them integral: it goes to ``done`` with its share, the other stays in hand.
STEP = """
(acc, e) -> case when acc.cur is null then named_struct('cur', e, 'done', acc.done) else
  transform(array(named_struct(
    'a', acc.cur, 'b', e,
    'fill_a', (1 - acc.cur.x) * acc.cur.s, 'void_a', acc.cur.x * acc.cur.s,
    'fill_b', (1 - e.x) * e.s, 'void_b', e.x * e.s)), p ->
  transform(array(named_struct('d_in', least(p.fill_a, p.void_b), 'd_out', least(p.void_a, p.fill_b))), d ->
    case when {u} * (d.d_in + d.d_out) < d.d_out
    then case when p.fill_a <= p.void_b
      then named_struct('cur', {moved_b_down}, 'done', array_append(acc.done, {a_one}))
      else named_struct('cur', {moved_a_up}, 'done', array_append(acc.done, {b_zero})) end
    else case when p.void_a <= p.fill_b
      then named_struct('cur', {moved_b_up}, 'done', array_append(acc.done, {a_zero}))
      else named_struct('cur', {moved_a_down}, 'done', array_append(acc.done, {b_one})) end
    end)[0])[0] end
"""


def _unit(of: str, x: str) -> str:
    fields = [f.split()[0] for f in UNIT.split(", ")]
    return "named_struct(" + ", ".join(f"'{f}', " + (f"least(greatest({x}, 0D), 1D)" if f == "x" else f"{of}.{f}") for f in fields) + ")"


def _fold(units: str, seed: int) -> str:
    step = STEP.format(
        u=f"((xxhash64({seed}, p.a.uid, p.b.uid) & 9007199254740991L) / 9007199254740992D)",
        a_one=_unit("p.a", "1D"), a_zero=_unit("p.a", "0D"), b_one=_unit("p.b", "1D"), b_zero=_unit("p.b", "0D"),
        moved_b_down=_unit("p.b", "p.b.x - d.d_in / p.b.s"), moved_b_up=_unit("p.b", "p.b.x + d.d_out / p.b.s"),
        moved_a_up=_unit("p.a", "p.a.x + d.d_in / p.a.s"), moved_a_down=_unit("p.a", "p.a.x - d.d_out / p.a.s"),
    )
    kind = "struct<" + ", ".join(f"{f.split()[0]}: {f.split()[1].replace('long', 'bigint')}" for f in UNIT.split(", ")) + ">"
    return f"aggregate({units}, named_struct('cur', cast(null as {kind}), 'done', cast(array() as array<{kind}>)), {step})"


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``source, source_size, docs, target`` from ``source, size, n`` rows, n documents of one size each.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times the total
    size; none gets more than ``cap`` times its own size, and the excess goes to the others by weight
    until none is above. That ends at one level L with target = min(cap * size, L * weight): with sources
    by cap * size / weight, L is what is left after the capped ones over the weight of the rest. The
    windows run over the table of sources, one row each.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double"))
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size"))
    fill = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("w").over(after))
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "level"))).over(whole)
    target = F.least("most", F.coalesce(level["level"] * F.col("w"), F.col("most")))
    return ranked.select("source", "source_size", "docs", target.alias("target"))


def _each(df: DataFrame, count: Column) -> DataFrame:
    """Every row of ``df`` ``count`` times, with a ``number`` from 1; a large count is dealt out over tasks by chunks."""
    chunked = df.withColumn("of", count).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / CHUNK).cast("int"))))
    dealt = chunked.where("chunk = 0 and of <= %d" % CHUNK).union(chunked.where("of > %d" % CHUNK).repartition("uid", "chunk"))
    first = F.col("chunk").cast("long") * CHUNK
    return dealt.withColumn("number", F.explode(F.sequence(first + 1, F.least(first + CHUNK, "of")))).drop("of", "chunk")


def _uid(docs: DataFrame) -> Column:
    """A hash of the whole row. Maps have none; their JSON text has."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[plain(f) for f in sorted(docs.schema, key=lambda f: f.name)])


def _mixed(docs: DataFrame, share: float, cap: float, weights: tuple[int, ...], fan: int, seed: int) -> DataFrame:
    """``uid, doc_id, size, n, source_size, target, copies``: for every distinct row of ``docs`` how often it repeats and how many copies its repeats get."""
    sized = docs.select(
        _uid(docs).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # n equal rows with x copies each are one unit: they take the whole part of n * x, and the rest is for chance
    sized = materialise(sized.groupBy("uid", "doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = materialise(source_targets(sized, share, cap, weights).withColumnRenamed("source", "of"), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mass = (copies - F.floor(copies)) * F.col("n")
    units = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "uid", F.col("size").cast("double").alias("s"), (mass - F.floor(mass)).alias("x"), "doc_id", "size", "n", "source_size", "target",
        (F.floor(copies) * F.col("n") + F.floor(mass)).cast("long").alias("base"), "source", F.greatest(F.ceil(F.col("docs") / fan), F.lit(1)).cast("long").alias("groups"),
    )
    loose = (F.col("size") > 0) & (F.col("x") > 0)
    whole = units.where(~loose).select("uid", "doc_id", "size", "n", "source_size", "target", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0)).cast("long").alias("copies"))
    at = units.where(loose).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.col("groups")))
    groups = targets.agg(F.max(F.greatest(F.ceil(F.col("docs") / fan), F.lit(1)))).first()[0] or 0
    decided, level = [whole], 0
    unit = F.struct(*[f.split()[0] for f in UNIT.split(", ")])
    while groups:
        folded = at.groupBy("source", "groups", "g").agg(F.sort_array(F.collect_list(unit)).alias("units"))
        folded = folded.withColumn("end", F.expr(_fold("units", seed + level)))
        last = F.col("groups") == 1
        rounded = F.when(F.col("end.cur.x") >= 0.5, 1.0).otherwise(0.0)
        cur = F.when(last, F.col("end.cur").withField("x", rounded)).otherwise(F.col("end.cur"))
        rows = folded.select(
            "source", "groups", "g",
            F.explode(F.array_compact(F.concat(F.transform("end.done", lambda u: F.struct(u.alias("u"), F.lit(True).alias("set"))), F.array(F.when(F.col("end.cur").isNotNull(), F.struct(cur.alias("u"), last.alias("set"))))))).alias("r"),
        )
        rows = materialise(rows.select("source", "groups", "g", "r.set", "r.u.*"), f"mix-level-{level}")
        decided.append(rows.where("set").select("uid", "doc_id", "size", "n", "source_size", "target", (F.col("base") + F.col("x")).cast("long").alias("copies")))
        at = rows.where("not set").drop("set").withColumn("g", F.floor(F.col("g") / fan).cast("long")).withColumn("groups", F.ceil(F.col("groups") / fan).cast("long"))
        groups, level = (0 if groups == 1 else -(-groups // fan)), level + 1
    return reduce(DataFrame.unionByName, decided)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), fan: int = 32, seed: int = 7) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns ``uid`` (a hash of the whole row), ``doc_id, size, source_size, target, copies``, one row per
    row of ``docs``. Size is the number of words of the whole text, however long, 0 for a null text. The words taken from a source,
    ``sum(size * copies)``, miss its target by at most half of its last document, which is rounded to the
    nearer side; copies never exceed ``cap``. Draws depend on the rows and ``seed`` only, so reruns agree. An empty or null text has size 0
    and is never copied. Null sources are one source, the last. Rows that repeat are separate documents; they are counted first, so
    any number of equal rows costs no more than one. Other columns only enter the hash. An empty table gives none.
    """
    mixed = _mixed(docs, share, cap, weights, fan, seed)
    names = ["uid", "doc_id", "size", "source_size", "target"]
    # equal rows split their copies by number
    share_ = F.floor((F.col("copies") + F.col("n") - F.col("number")) / F.col("n")).cast("long")
    return mixed.where("n = 1").select(*names, "copies").union(_each(mixed.where("n > 1"), F.col("n")).select(*names, share_.alias("copies")))


def mix_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), fan: int = 32, seed: int = 7) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as ``mix`` takes it, with all columns.

    Null, empty and very long texts, ties, repeated rows and empty tables are as for ``mix``.
    """
    names = docs.columns
    taken = materialise(_mixed(docs, share, cap, weights, fan, seed).where("copies > 0").select("uid", "n", "copies"), "mix-taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _uid(docs).alias("uid"))
    single = rows.join(taken.where("n = 1").drop("n"), "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    repeated = taken.where("n > 1")
    if repeated.isEmpty():
        return single.select("row.*")
    # equal rows first become one, on the map side already
    once = rows.join(repeated.select("uid"), "uid", "left_semi").groupBy("uid").agg(F.any_value("row").alias("row"))
    again = _each(once.join(repeated.drop("n"), "uid"), F.col("copies"))
    return single.select("row.*").union(again.select("row.*"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes from every row of ``documents``; null, empty and repeated rows as ``mix`` defines them."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
