"""Line dedup: levelled sorted runs of line hashes.

Documents come in batches. Every batch reduces its lines to one entry per line key, merge-anti-joins
the runs written so far to tell keys seen before from new ones, and adds its entries as a new sorted
run. Runs of a level are compacted into one run of the next level once there are ``fanout`` of them. Runs are tables bucketed and
sorted by key, so neither merging nor compaction shuffles them again.
Only hashes, ids and line numbers are shuffled; a text is shuffled once, to meet its own drop list.

DataFrame functions only; nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, NULL_ID, Scratch, ascii_lower, forget, materialise, shared_path, table


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """An index of line keys as levelled sorted runs: tables in the shared folder, bucketed and sorted by key.

    An entry is ``h1, h2`` (128 bits of the key), ``n`` (documents of the batch that hold it) and
    ``keeper`` (the largest document id of the batch that first brought the key; null in later ones).
    Batches must come by falling document id, so that the keeper is the largest id of all. All runs have the
    same buckets, as many as the session has shuffle partitions, so merging them with a batch or with one another moves none of their rows.
    """

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [[]], {}
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # the most that Spark allows

    def _read(self, names: list[str]) -> DataFrame:
        """The entries of several runs. The filter passes all; it keeps the union off the columnar path, on which Spark 4.1 says
        that buckets stay together, but appends them."""
        return reduce(DataFrame.union, [self.spark.table(name).where("n > 0") for name in names])

    def entries(self) -> DataFrame:
        return self._read([name for level in self.levels for name in level])

    def _table(self, run: DataFrame, label: str) -> str:
        """``run`` as a sorted run; its name."""
        path = shared_path(self.spark, label)
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        run.write.format("parquet").option("path", path).bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            forget(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Delete all runs."""
        self._drop([*self.paths])
        self.levels = [[]]

    def _keep(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._table(run, f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge all runs of a level into one run of the next."""
        names, self.levels[level] = self.levels[level], []
        self._keep(self._read(names).groupBy(*self.KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")), level + 1)
        self._drop(names)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``doc, h1, h2`` rows, repeats allowed, as a run: keys that no run holds bring their keeper."""
        own = lines.groupBy(*self.KEY).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
        if not any(self.levels):
            return self._keep(own, 0)
        batch = self._table(own, "line-batch")
        own, seen = self.spark.table(batch), self.entries().where("keeper is not null").select(*self.KEY)
        fresh = own.join(seen, [*self.KEY], "left_anti")
        known = own.join(seen, [*self.KEY], "left_semi").withColumn("keeper", F.lit(None).cast("long"))
        self._keep(fresh.union(known), 0)
        self._drop([batch])

    def common(self, min_docs: int) -> DataFrame:
        """``h1, h2, keeper`` of the keys that at least ``min_docs`` documents hold."""
        total = self.entries().groupBy(*self.KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
        return total.where(F.col("n") >= min_docs).select(*self.KEY, "keeper")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def _row() -> Column:
    return F.xxhash64(F.col("text"))


def _drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int, kept: Scratch) -> DataFrame:
    """``doc, row, drop_at``: the numbers of the lines that a text of a document loses."""
    spark = docs.sparkSession
    hashed = (
        docs.select(_doc().alias("doc"), _row().alias("row"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
        .withColumn("line", F.trim(F.col("line"), F.lit(ASCII_SPACE)))
        .where(F.char_length("line") >= min_chars)
        .withColumn("line", ascii_lower(F.col("line")))
        .select("doc", "row", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    )
    hashed = kept.table(hashed, "line-hashes")
    cuts = hashed.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    runs, above = LineRuns(spark, fanout), None
    try:
        for low in [*sorted(set(cuts), reverse=True), None]:
            batch = hashed if low is None else hashed.where(F.col("doc") >= low)
            runs.add((batch if above is None else batch.where(F.col("doc") < above)).select("doc", "h1", "h2"))
            above = low
        common = kept.table(runs.common(min_docs), "common-lines")
    finally:
        runs.close()
    drops = hashed.join(common, ["h1", "h2"]).where(F.col("doc") < F.col("keeper")).groupBy("doc", "row").agg(F.collect_set("at").alias("drop_at"))
    return materialise(drops, "dropped-lines")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop lines that many documents share, except in the largest ``doc_id`` that holds them.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    ``min_chars`` code points held by at least ``min_docs`` documents lose their lines in every
    document but the keeper; all lines of a key in one document share its fate. Returns the columns of
    ``docs`` with ``text`` replaced, and ``n_lines`` (before), ``n_dropped``.

    A null text reads as one empty line and comes back as an empty text. A null ``doc_id`` counts as
    one document, smaller than all others. Rows that repeat a ``doc_id`` are one document for the
    count and the keeper, and each keeps its own text. A very long text is one row, a line that very many documents hold is
    one entry per batch. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives none.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select([F.col(f"`{c}`") for c in rest])
    with Scratch(spark, "line-dedup") as kept:
        drops = _drops(docs, min_chars, min_docs, batches, fanout, kept)
    doc, row = _doc(), _row()
    own = {c: f"in_{i}" for i, c in enumerate(rest)}
    named = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()], doc.alias("doc"), row.alias("row"))
    joined = named.join(drops, ["doc", "row"], "left")
    text = F.coalesce(F.col(own["text"]), F.lit(""))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of(text)) - 1), F.col("drop_at"))
    # the outer transform binds the split lines once; a plain reference would split again for each line
    rebuilt = F.transform(
        F.array(lines_of(text)), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n")
    )[0]
    return joined.select(
        *[(F.when(F.col("drop_at").isNull(), text).otherwise(rebuilt) if c == "text" else F.col(a)).alias(c) for c, a in own.items()],
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that every text of ``documents`` loses; null, empty and repeated rows as ``dedup_lines`` defines them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), common as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), marked as (
  select d.doc_id, d.pos, d.line, c.k is not null and d.doc_id < c.keeper as gone
  from keyed d left join common c on d.k = c.k
)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
