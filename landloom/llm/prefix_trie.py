"""Conversation prefix trie: which conversations share their first turns, and what sharing them saves.

Turns are sorted by range, so that a long conversation may span partitions. A NumPy scan gives every turn its place and two
polynomial fingerprints of the conversation up to it; the sums that cross partitions are added from the totals of the
few conversations cut by a border. Fingerprints roll: the prefix of a conversation whose head is swapped follows from the
prefixes of both parts without another scan. Prefixes of equal depth and fingerprint are one group; each group is verified turn by
turn (its parent group, role and text have to equal those of its representative, the smallest conversation), and groups that
collide are split until none does. Sums over subtrees need no walk: a conversation represents the nodes from some depth on,
so that each brings its own chain of nodes to all nodes above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, table

#: Moduli (primes below 2^31, so that products fit 64 bits) and bases of the two fingerprints.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
#: Turns of a conversation that are summed at once; conversations whose numbers are joined at once.
BLOCK, NAMES = 1024, 10_000


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n``, by doubling."""
    out = np.ones(n, np.int64)
    done, step = 1, base % prime
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % prime
        done, step = done + more, step * step % prime
    return out


def _scan(primes: tuple[int, int]):
    """Adds to sorted ``part, conv_id, role, text, t0, t1`` the place in the conversation and its fingerprints up to this turn.

    Batches are a stream: the conversation that a batch ends in goes on in the next. What other partitions hold is not known here.
    """

    def run(batches):
        last, place, at = None, 0, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(1).to_numpy()
            new = np.flatnonzero(np.diff(conv, prepend=conv[0]) != 0)
            starts = np.concatenate([[0], new])
            sizes = np.diff(starts, append=len(conv))
            carried = conv[0] == last
            offset = np.zeros(len(starts), np.int64)
            offset[0] = place if carried else 0
            pos = np.arange(len(conv)) - np.repeat(starts - offset, sizes) + 1
            columns, carry = [], []
            for k, (prime, base) in enumerate(zip(primes, BASES, strict=True)):
                power = powers(base, prime, int(sizes.max()) + 1)
                within = np.arange(len(conv)) - np.repeat(starts, sizes) + 1
                term = b.column(4 + k).to_numpy() % prime * power[within] % prime
                shift = np.array([pow(base, int(offset[0]), prime)] + [1] * (len(starts) - 1), np.int64)
                term = term * np.repeat(shift, sizes) % prime
                run_ = np.cumsum(term)  # fewer than 2^32 terms below 2^31
                before = np.repeat((run_ - term)[starts], sizes)
                start = np.zeros(len(starts), np.int64)
                start[0] = at[k] if carried else 0
                after = (run_ - before + np.repeat(start, sizes)) % prime
                columns += [pa.array((after - term) % prime), pa.array(after)]
                carry.append(int(after[-1]))
            last, place, at = conv[-1], int(pos[-1]), carry
            yield pa.record_batch([*b.columns[:4], pa.array(pos), *columns], names=["part", "conv_id", "role", "text", "pos", "g0", "f0", "g1", "f1"])

    return run


def scanned(rows: DataFrame, kept: Scratch, primes: tuple[int, int]) -> DataFrame:
    """``conv_id, role, text, pos, f0, f1`` and ``g0, g1``, the fingerprints before the turn; ``pos`` counts from 1."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    hashed = rows.select("*", *[F.shiftright(F.xxhash64("role", "text", F.lit(k)), 1).bitwiseAND(F.lit(2**62 - 1)).alias(f"t{k}") for k in (0, 1)])
    # the last key deals rows that repeat over several partitions: equal rows may come in any order
    dealt = hashed.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    spec = "part int, conv_id long, role string, text string, pos long, g0 long, f0 long, g1 long, f1 long"
    local = dealt.select(F.spark_partition_id().alias("part"), "conv_id", "role", "text", "t0", "t1").mapInArrow(_scan(primes), spec)
    local = kept.table(local, "scanned")
    ends = local.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by("f0", "pos").alias("f0"), F.max_by("f1", "pos").alias("f1"))
    cut = ends.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1")
    carried, sums = [], {}
    for r in sorted(cut.collect(), key=lambda r: (r["conv_id"], r["part"])):  # at most two rows per partition of the sort
        n, f = sums.get(r["conv_id"], (0, (0, 0)))
        carried.append((r["conv_id"], r["part"], n, *f, *(pow(b, n, p) for b, p in zip(BASES, primes, strict=True))))
        sums[r["conv_id"]] = n + r["n"], tuple((x + r[f"f{k}"] * pow(BASES[k], n, primes[k])) % primes[k] for k, x in enumerate(f))
    if not carried:
        return local.drop("part")
    more = local.sparkSession.createDataFrame(carried, "conv_id long, part int, n long, c0 long, c1 long, p0 long, p1 long")
    joined = local.join(F.broadcast(more), ["conv_id", "part"], "left")
    moved = lambda c, k: F.when(F.col("n").isNull(), F.col(c)).otherwise((F.col(f"c{k}") + F.col(c) * F.col(f"p{k}") % primes[k]) % primes[k]).alias(c)
    return joined.select("conv_id", "role", "text", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), moved("g0", 0), moved("f0", 0), moved("g1", 1), moved("f1", 1))


def rebuilt(rows: DataFrame, base: Column, shared: Column, most: int, kept: Scratch, primes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """All turns after the first ``shared`` turns of every conversation are replaced by those of conversation ``base``.

    Gives the conversations (``conv_id, n_turns``) and their turns (``conv_id, depth, role, text, prev, label``), where ``label`` is the
    fingerprint up to the turn and ``prev`` that before it. ``shared`` is at most ``most`` turns.
    """
    turns = kept.table(scanned(rows, kept, primes), "turns")
    both = F.struct(*[F.col(f"f{k}").alias(f"f{k}") for k in (0, 1)])
    convs = turns.withColumn("h", shared).groupBy("conv_id", "h").agg(
        F.max("pos").alias("own"), F.max(F.when(F.col("pos") == F.col("h"), both)).alias("skipped")
    )
    turn = F.struct("pos", "role", "text", "g0", "f0", "g1", "f1")
    heads = turns.where(F.col("pos") <= most).where(F.col("conv_id").eqNullSafe(base)).groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = convs.withColumn("base", base).join(heads, F.col("base") == F.col("of"), "left")
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    convs = convs.select("conv_id", "h", "own", "skipped", F.coalesce(head, F.array().cast(heads.schema["head"].dataType)).alias("head"))
    convs = convs.withColumn("k", F.size("head")).withColumn("n_turns", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = kept.table(convs, "conversations")
    label = lambda f: (f[0] * F.lit(2**31) + f[1]).alias
    first = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.role", "t.text", label([F.col("t.g0"), F.col("t.g1")])("prev"), label([F.col("t.f0"), F.col("t.f1")])("label")
    )

    def moved(c: str, k: int) -> Column:
        """A prefix of the own turns, without those skipped, behind the new head: its powers move by the difference of the lengths."""
        prime = primes[k]
        back = F.element_at(F.array(*[F.lit(pow(BASES[k], -i, prime)) for i in range(most + 1)]), (F.col("h") - F.col("k") + 1).cast("int"))
        rest = F.pmod(F.col(c) - F.coalesce(F.col("skipped")[f"f{k}"], F.lit(0)), F.lit(prime))
        before = F.when(F.col("k") > 0, F.element_at("ends", -1)[f"f{k}"]).otherwise(0)
        return (before + rest * back % prime) % prime

    rest = turns.join(convs.select("conv_id", "h", "k", "skipped", F.slice("head", F.greatest("k", F.lit(1)), F.lit(1)).alias("ends")), "conv_id").where(F.col("pos") > F.col("h"))
    rest = rest.select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "role", "text",
        label([moved("g0", 0), moved("g1", 1)])("prev"), label([moved("f0", 0), moved("f1", 1)])("label"),
    )
    return convs.select("conv_id", F.col("n_turns").cast("long").alias("n_turns")), first.unionByName(rest)


def nodes_of(turns: DataFrame, kept: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (``depth, label, prev, conv_id, n_convs, chars``) and turns (``conv_id, depth, label``), with groups that collide split.

    A node is one content (parent, role and text) of a group; rows are counted before they meet, so that a turn that many
    conversations share is one row per task. In a group of several contents all but the representative's get labels of
    their own, and the turns that follow see another parent in the next round; prefixes that are equal stay together in every round.
    """
    for round_ in range(1000):
        turns = kept.table(turns, "labelled")
        nodes = turns.groupBy("depth", "label", "prev", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        nodes = kept.table(nodes, "contents")
        split = nodes.groupBy("depth", "label").agg(F.count("*").alias("contents")).where("contents > 1").select("depth", "label")
        split = kept.table(split, "collisions")
        if split.isEmpty():
            found = nodes.select("depth", "label", "prev", "conv_id", "n_convs", F.char_length("text").cast("long").alias("chars"))
            return found, turns.select("conv_id", "depth", "label")
        rank = F.row_number().over(Window.partitionBy("depth", "label").orderBy("conv_id", "prev", "role", "text"))
        moved = nodes.join(split, ["depth", "label"], "left_semi").withColumn("nth", rank).where("nth > 1").drop("conv_id", "n_convs")
        same = ["depth", "label", "prev", "role", "text"]
        fresh = F.when(F.col("nth").isNull(), F.col("label")).otherwise(F.xxhash64("label", "nth", F.lit(round_)))
        turns = turns.join(moved, same, "left").select("conv_id", "depth", "role", "text", fresh.alias("label"))
        above = turns.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("label").alias("above"))
        turns = turns.join(above, ["conv_id", "depth"], "left").select("conv_id", "depth", "role", "text", F.coalesce("above", F.lit(0)).alias("prev"), "label")
    raise ValueError("some groups of prefixes still collide")


def _digests(batches):
    """SHA-256 of the texts of each (depth, label), whose blocks come one after the other; one digest is open at a time."""
    names = ["depth", "label", "ends_sha256"]
    key, open_ = None, None
    for b in batches:
        done = []
        for depth, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (depth, label) != key:
                if open_:
                    done.append((*key, open_.hexdigest()))
                key, open_ = (depth, label), hashlib.sha256(text.encode())
            else:
                open_.update(b"," + text.encode())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
    if open_:
        yield pa.record_batch([pa.array([x]) for x in (*key, open_.hexdigest())], names=names)


def trie(rows: DataFrame, base: Column, shared: Column, most: int, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The prefix trie of conversations whose first ``shared`` turns come from conversation ``base``: one row per node.

    ``rows`` has ``conv_id, turn, role, text``; ``base`` and ``shared`` are expressions of ``conv_id``, and a base is its own base; ``shared`` is at most
    ``most``. Nodes are the distinct sequences of first turns from the empty root on: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` (the conversations of exactly
    these turns).

    Turns come in order of ``turn``, nulls first, ties by role, then text; repeated rows stay. A null role or text is empty. Rows
    with a null ``conv_id`` belong to no conversation and are left out. Conversations and texts may be of any length. Other columns are ignored. An
    empty table gives no row, not even a root.
    """
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    with Scratch(rows.sparkSession, "trie") as kept:
        convs, turns = rebuilt(rows, base, shared, most, kept, primes)
        convs = kept.table(convs, "lengths")
        nodes, member = nodes_of(turns, kept)
        # the root is a row like the others, whose parent is no node
        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("label"), F.lit(None).cast("long").alias("prev"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
        member = member.union(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("label")))
        nodes = nodes.union(root)
        children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("label")).agg(F.count("*").alias("n_children"))
        nodes = nodes.join(children, ["depth", "label"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        nodes = kept.table(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
        # the nodes that a conversation represents are a chain; what is saved from each of them downwards, by blocks of the chain
        block = F.floor(F.col("depth") / BLOCK)
        inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        below = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        chain = nodes.select("conv_id", "depth", "label", "saved", block.alias("block"))
        blocks = chain.groupBy("conv_id", "block").agg(F.sum("saved").alias("all")).withColumn("rest", F.coalesce(F.sum("all").over(below), F.lit(0)))
        chain = chain.withColumn("saved", F.sum("saved").over(inside)).join(blocks, ["conv_id", "block"]).select("depth", "label", (F.col("saved") + F.col("rest")).alias("chain"))
        chains = nodes.groupBy(F.col("conv_id").alias("of")).agg(F.min("depth").alias("since"), F.sum("saved").alias("brings"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
        # every conversation brings its chain and its leaf to the nodes it passes
        passing = member.join(chains, F.col("conv_id") == F.col("of"))
        sums = passing.groupBy("depth", "label").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("since"), F.col("brings")).otherwise(0)).alias("others"))
        ends = member.join(convs.select(F.col("conv_id").alias("of"), "n_turns"), (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("n_turns")))
        ends = ends.groupBy("depth", "label", F.floor(F.col("conv_id") / NAMES).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("names"))
        ends = ends.withColumn("names", F.array_join(F.transform("names", lambda c: c.cast("string")), ","))
        ends = ends.repartition("depth", "label").sortWithinPartitions("depth", "label", "block").select("depth", "label", "names")
        ends = ends.mapInArrow(_digests, "depth long, label long, ends_sha256 string")
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("label").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
        key = ["depth", "label"]
        found = nodes.join(sums, key).join(chain, key).join(ends, key, "left").join(parents, ["depth", "prev"], "left")
        return materialise(
            found.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("chain") + F.col("others")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            ),
            "trie",
        )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations``, each with the first crc32(conv_id) % 6 turns of the conversation at its hundred; rows as ``trie`` defines them."""
    conv = F.col("conv_id")
    return trie(table(spark, sf_dir, "conversations"), conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"), 5)


ORACLE = """
with recursive crc(conv_id, bytes, i, c) as (
  select distinct conv_id, conv_id::varchar, 0, 4294967295::bigint from conversations where conv_id is not null
  union all
  select conv_id, bytes, i + 1, case when b & 1 = 1 then xor(b >> 1, 3988292384) else b >> 1 end
  from (select *, case when i % 8 = 0 then xor(c, ascii(substr(bytes, i // 8 + 1, 1))::bigint) else c end as b from crc where i < 8 * length(bytes))
), heads as (
  select conv_id, (xor(c, 4294967295) % 6)::int as h from crc where i = 8 * length(bytes)
), own as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id
), whole as materialized (
  select o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) as turns
  from own o join heads using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % 100
), paths as materialized (
  select conv_id, d, turns[1:d] as path, len(turns) = d as ends from (select *, unnest(range(0, len(turns) + 1)) as d from whole)
), nodes as materialized (
  select d, path, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * case when d = 0 then 0 else length(path[d].t) end as saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from paths group by d, path
), children as (
  select d - 1 as d, path[1:d - 1] as path, count(*) as n from nodes where d > 0 group by all
), full_nodes as materialized (
  select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c on c.d = n.d and c.path = n.path
), above as (
  select a as d, path[1:a] as path, saved, n_children from (select *, unnest(range(0, d + 1)) as a from full_nodes)
), sums as (
  select d, path, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from above group by d, path
)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from full_nodes n join sums s on s.d = n.d and s.path = n.path left join nodes p on p.d = n.d - 1 and p.path = n.path[1:n.d - 1]
"""
