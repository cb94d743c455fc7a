"""Similarity groups on word shingles against brute force, with planted copies and awkward rows."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landloom.llm import simhash
from landloom.llm.common import small_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words=5):
    w = simhash.words_of(text)
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, similarity=0.8):
    sets, parent = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if jaccard(x, y) >= similarity:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], DOCS)


def test_planted_copies_are_found_and_others_left_alone(spark):
    rng, rows, planted = random.Random(5), [], []
    for g in range(60):
        base = prose(rng, rng.randint(60, 600))
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            rows.append((10 * g + k, " ".join(edited(rng, base, 0.012 * k))))
        rows.append((10 * g + 4, " ".join(base).upper()))
        rows.append((10 * g + 5, " ".join(prose(rng, 100))))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    dropped, found = ({d for d, c in x.items() if c != d} for x in (want, got))
    assert found == dropped


def test_documents_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    dropped, found = ({d for d, c in x.items() if c != d} for x in (want, got))
    assert found == dropped


def test_large_group_of_near_copies(spark, monkeypatch):
    """Buckets are worked off by leaders, two in the first round; the counters of frequent shingles are so few that they collide."""
    monkeypatch.setattr(simhash, "COUNTERS", 64)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    rng = random.Random(8)
    one = prose(rng, 300)
    half = one[:150] + prose(rng, 150)
    rows = [(i, " ".join(edited(rng, one, 0.004))) for i in range(80)] + [(100 + i, " ".join(edited(rng, half, 0.004))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_shared_passage_links_nobody(spark):
    """Hundreds of documents share most of a passage but are not similar: frequent shingles come last, so they share no key."""
    rng = random.Random(21)
    passage = prose(rng, 60)
    rows = [(i, " ".join(prose(rng, rng.randint(20, 60)) + passage + prose(rng, 5))) for i in range(300)]
    rows += [(1000 + i, " ".join(passage + prose(rng, i % 12))) for i in range(120)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None), (2, ""), (3, " \n "), (None, "a b c d e f"), (None, None), (4, "A b C d e F"), (5, "one two"), (6, "one  two"), (6, "one two"),
        (7, "x" * 50000), (8, "word " * 30000), (9, "word " * 29000),
    ]
    return frame(spark, rows).withColumn("node", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("fp", F.lit(None).cast("int"))


def test_odd_rows(spark, odd):
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.similar_documents(odd).collect())
    assert sum(got.values()) == odd.count()
    # the two rows without an id are one document, which ties the texts without a word to the six-word one
    assert got[(1, None)] == got[(2, None)] == got[(3, None)] == got[(4, None)] == 1 and got[(None, None)] == 2
    assert got[(6, 5)] == 2 and got[(7, 7)] == 1 and got[(9, 8)] == 1
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5, 7, 8]
    assert simhash.similar_documents(odd.limit(0)).count() == 0 and simhash.drop_near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["edited", "appended", "truncated", "short"])
def test_no_kind_of_copy_is_missed(spark, kind):
    """Pairs of similarity 0.8 to 0.9 or just below, each kind by itself."""
    rng, rows = random.Random(13), []
    for g in range(150):
        base = prose(rng, rng.randint(9, 30) if kind == "short" else rng.randint(60, 1500))
        n = len(base)
        if kind == "edited":
            other = edited(rng, base, 0.02)
        elif kind == "truncated":
            other = base[: int(n * rng.uniform(0.78, 0.9))]
        else:
            other = base + prose(rng, max(1, int(n * rng.uniform(0.1, 0.27))))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    want = brute(rows)
    assert sum(d != c for d, c in want.items()) > 30
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()} == want


def test_pairs_of_small_buckets_meet_once_without_parities_in_their_rows(spark, monkeypatch):
    """Documents that share a passage by twos share many keys; only buckets of many rows are carried through rounds."""
    rows_of = {}
    real = simhash.Scratch.table

    def table(self, df, label):
        done = real(self, df, label)
        rows_of.setdefault(label, []).append(done.count())
        return done

    monkeypatch.setattr(simhash.Scratch, "table", table)
    rng, rows = random.Random(3), []
    for g in range(40):
        passage = prose(rng, 80)
        rows += [(2 * g, " ".join(passage + prose(rng, 70))), (2 * g + 1, " ".join(passage + prose(rng, 10 if g % 2 else 70)))]
    rows += [(1000 + g, t) for g, (_, t) in enumerate(rows[:10])] + [(2000 + g, t + " more") for g, (_, t) in enumerate(rows[:10])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert rows_of["open-buckets"] == [0] * len(rows_of["open-buckets"])
    assert 10 <= rows_of["pairs-of-few"][0] <= 60
    assert rows_of["judged-nodes"][0] == 20  # only these move their sets


def test_a_sieve_passes_all_its_ids_and_few_others(spark):
    ids = spark.range(-3000, 3000, 3).union(spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "id long"))
    bits = simhash.sieve(ids)
    hashes = lambda df: df.select(F.xxhash64("id").alias("h")).toArrow().column("h").to_numpy()
    assert simhash.passes(bits, hashes(ids)).all()
    assert simhash.passes(bits, hashes(spark.range(10_000, 30_000))).mean() < 0.02
    assert not simhash.passes(simhash.sieve(ids.limit(0)), hashes(ids)).any()


def test_a_full_sieve_changes_no_result(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(60)) + (" more" if i % 2 else "")) for i in range(40)] + [(8, "again " * 9), (None, "no id at all but six words")]
    docs = frame(spark, rows)
    want = sorted(map(str, simhash.drop_near_duplicates(docs).select("doc_id").collect()))
    monkeypatch.setattr(simhash, "SIEVE", 1 << 3)
    assert sorted(map(str, simhash.drop_near_duplicates(docs).select("doc_id").collect())) == want
    assert len(want) == 21


def test_only_texts_that_are_asked_for_are_shuffled(spark):
    # without broadcasts, as ids are at scale: the texts to keep are on the branch of the union that has no join
    rows = [(i, " ".join(f"{hash((i - i % 10 if i % 10 < 2 else i, k)) & 0xFFFFFFFF:x}" for k in range(300))) for i in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.drop_near_duplicates(frame(spark, rows))
        assert kept.count() == 360
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "maybe" in plan and "LeftAnti" in plan and "Union" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_are_small_within_the_block_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), small_batches(spark, 7):
        sizes = spark.range(0, 20, 1, 1).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long")
        assert max(r.n for r in sizes.collect()) == 7
        raise ValueError
    assert spark.conf.get(name) == before
