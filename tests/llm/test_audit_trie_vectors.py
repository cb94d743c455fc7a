"""The filter audit, the prefix trie and the vector near-dedup against brute force, and on awkward rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.llm import filter_audit, hnsw, prefix_trie, vector_dedup
from landloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit --------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        words, text = WORD.findall(text or ""), text or ""
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs),
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            open_ = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [r for r in open_ if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                open_, gone = [r for r in open_ if f not in r[1]], gone + hit
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, order, step] = (len(open_), len(hit), redundant, unique, sum(r[2] for r in hit), sum(r[3] for r in hit))
                shapley[part, f] += len(hit)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")).withColumn("a.b", F.create_map(F.lit(1), F.lit(2))).withColumn("word", F.lit(1))
    found = filter_audit.audit(df.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}


def test_audit_equals_loop_on_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, None, "en"), (2, "", "en"), (3, "", None), (None, "", "en"), (None, "", "en"), (4, long, "en"), (5, long, "de"), (5, long, "de"), (5, long + " other", "en"), (6, long, ""), (7, "\x0b" + "same " * 250 + "\f", "en"),
        (8, "AB " * 400, "de"), (9, long + " #", "en"), (9, long + " #", "en"), (10, "é ü " * 210, None), (11, "word " * 50_000, "en"), (12, "X" * 20_000, "fr"), (2**62, long, "en"),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (9, None, 1), (9, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 1)]
    assert audited(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


# --- prefix trie ---------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = {}
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in under if not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in members)]
        ends = [c for c in who if len(whole[c]) == len(path)]
        out[who[0], len(path)] = (
            members[path[:-1]][0] if path else None, len(who), sum(len(p) == len(path) + 1 for p in under), len(leaves),
            sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def tried(spark, rows, primes=prefix_trie.PRIMES):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("label.x", F.lit(1))
    conv = F.col("conv_id")
    found = prefix_trie.trie(df.repartition(3), conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"), 5, primes).collect()
    assert len({(r.conv_id, r.depth) for r in found}) == len(found)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(3)
    rows = [(int(c), t, ["user", "assistant", None][t % 3], ["a", "b", "Größe", "", None, "long " * 40][rng.integers(6)]) for c in rng.choice(450, 150, replace=False) for t in range(rng.integers(1, 9))]
    rows += [(700, t, "user", f"turn {t}") for t in range(60)] + [(703, t, "user", f"turn {t}") for t in range(60)]  # longer than a partition of the sort
    rows += [(800, None, None, None), (800, None, None, None), (800, 1, "u", "x"), (801, 2, "u", "b"), (801, 2, "u", "a"), (None, 1, "u", "y"), (-5, 1, "u", "z"), (-205, 3, "u", "q" * 30_000), (10_004, 0, "user", "a"), (25_000, 0, "user", "a")]
    return rows + [(900, 1, "user", "again")] * 40


def test_trie_equals_loop(spark, talks):
    assert tried(spark, talks) == trie_by_hand(talks)


def test_trie_splits_groups_that_collide(spark, talks):
    """With moduli of 2 and 3 nearly all groups collide; the nodes stay the same."""
    some = [r for r in talks if r[0] is not None and r[0] < 260]
    assert tried(spark, some, (2, 3)) == trie_by_hand(some)


def test_trie_of_nothing(spark):
    assert tried(spark, []) == {}


def test_scan_goes_on_over_partitions_and_batches(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        with Scratch(spark, "scan") as kept:
            found = prefix_trie.scanned(rows, kept, prefix_trie.PRIMES).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [int(r.text) + 1 for r in found] == [r.pos for r in found] == list(range(1, 5001))
    hashes = {r.text: r for r in rows.select("text", *[(F.shiftright(F.xxhash64("role", "text", F.lit(k)), 1).bitwiseAND(F.lit(2**62 - 1))).alias(f"t{k}") for k in (0, 1)]).collect()}
    for k in (0, 1):
        at, prime = 0, prefix_trie.PRIMES[k]
        for r in found:
            assert r[f"g{k}"] == at
            at = (at + hashes[r.text][f"t{k}"] % prime * pow(prefix_trie.BASES[k], r.pos, prime)) % prime
            assert r[f"f{k}"] == at


# --- vectors -------------------------------------------------------------------------------------------


def near_by_hand(rows, least):
    """rows: (vec_id, vector, label); the result of each row, in order."""
    sound = [k for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.sqrt((np.array(rows[k][1], float) ** 2).sum()) for k in sound}
    links = {k: [j for j in sound if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= least] for k in sound}
    at = {rows[k][0]: rows[k][0] for k in sound}
    moved = True
    while moved:
        moved = False
        for k in sound:
            m = min([at[rows[k][0]], *(at[rows[j][0]] for j in links[k])])
            moved |= m != at[rows[k][0]]
            at[rows[k][0]] = m
    return [(i, len(links.get(k, [])), at.get(i, i), i is not None and at.get(i, i) == i) for k, (i, _, _) in enumerate(rows)]


def deduped(spark, rows, shard=vector_dedup.SHARD):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("size", F.lit(1)).withColumn("n.n", F.lit(1)).withColumn("id", F.lit("x"))
    return collections.Counter(tuple(r) for r in vector_dedup.near_vectors(df, 0.93, shard).collect())


def test_vectors_on_awkward_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [
        (5, a, 1), (9, b, 1), (9, b, 1), (2, a, 2), (7, [2.0, 0.0, 0.0], 1), (8, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (10, [float("inf"), 1.0, 0.0], 1),
        (11, [None, 1.0, 0.0], 1), (12, a, None), (None, a, 1), (13, [], 1), (14, [-1.0, 0.0, 0.0], 1), (9, [0.0, 1.0, 0.0], 2), (1, [0.0, 0.9, 0.1], 2),
    ]
    floats = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], l) for i, v, l in rows]
    assert deduped(spark, rows) == collections.Counter(near_by_hand(floats, 0.93))
    assert deduped(spark, []) == {}


def test_vectors_over_many_shards_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((400, 24))
    x = [centres[k] + 0.12 * rng.standard_normal(24) for k in range(400) for _ in range(rng.integers(1, 5))] + [centres[0] + 0.1 * rng.standard_normal(24) for _ in range(300)] + [centres[1]] * 200
    rows = [(int(i), [float(np.float32(c)) for c in v], int(i) % 2) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    assert deduped(spark, rows, 200) == collections.Counter(near_by_hand(rows, 0.93))


def test_graph_finds_links_without_comparing_all():
    """A graph with layers: recall of links, audits that widen, and the share of nodes that a search sees."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 16))
    x[1::2] = x[::2] + 0.15 * rng.standard_normal((3000, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    g = hnsw.Graph.of(x, np.arange(6000))
    assert g.top >= 1 and all((links < 6000).all() for links in g.links)
    found, beam, recall = vector_dedup.audited(g, x, x[::20], 0.93)
    true = x[::20] @ x.T >= 0.93
    assert recall >= vector_dedup.RECALL and 4 * beam <= g.n
    assert (found & true).sum() >= 0.99 * true.sum()
    poor = hnsw.Graph(x, g.level, [np.where(np.arange(n.shape[1]) < 3, n, -1) for n in g.links])
    assert vector_dedup.audited(poor, x, x[:1], 0.93)[1] > beam
