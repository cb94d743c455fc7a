"""The corpus pipeline stage by stage against brute force, and on awkward rows."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from landloom.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, data):
    """The input and output rows of every stage over the test documents."""
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, data).cache()
        found.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return found


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "BPE"]
    assert all(s[3] == P.COLUMNS for s in stages[:4])


def test_language_rejects_only_the_unclear(spark, stages):
    _, before, after, _ = stages[0]
    kept = {r.doc_id for r in after}
    rows = [r for r in before if r.text and r.lang]
    prose = [r for r in rows if len(WORD.findall(r.text)) >= 20]
    assert sum(r.doc_id in kept for r in prose) >= 0.98 * len(prose)
    assert not any(r.doc_id in kept for r in before if not any(c.isalpha() for c in r.text or ""))
    lang = {r.doc_id: r.lang for r in before}
    assert sum(r.lang == lang[r.doc_id] for r in after) >= 0.97 * len(after)


def test_lines_are_those_of_brute_force(stages):
    _, before, after, _ = stages[1]
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for r in before:
        for line in r.text.split("\n"):
            holders[lower(line)].add(r.doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if gone.get(lower(x), r.doc_id) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_one_document_of_each_group_stays(stages):
    _, before, after, _ = stages[2]
    kept = {r.doc_id for r in after}
    sets = [(r.doc_id, shingles(r.text)) for r in before]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if (len(x & y) >= 0.8 * len(x | y)) if x | y else True:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    heads = {find(d) for d, _ in sets}
    assert heads <= kept
    assert len(kept - heads) <= 0.03 * (len(sets) - len(heads)) + 1


def test_mix_takes_what_targets_ask(stages):
    _, before, after, _ = stages[3]
    size = lambda rows: collections.Counter(s for r in rows for s in [r.source] * len(WORD.findall(r.text)))
    have, taken, most = size(before), size(after), max(len(WORD.findall(r.text)) for r in before)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(have.values()), abs=most * len(have))
    assert all(taken[s] <= 2 * have[s] for s in have)
    assert max(collections.Counter(r.doc_id for r in after).values()) <= 2


def test_tokens_are_those_of_the_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    _, before, after, _ = stages[4]
    assert collections.Counter(r.doc_id for r in before) == collections.Counter(r.doc_id for r in after)
    text = {r.doc_id: r.text for r in before}
    for r in after:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids) == (len(ids), " ".join(map(str, ids)))
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_rows_of_the_last_stage(spark, data, stages):
    key = lambda rows: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows)
    assert key(P.run(spark, data).collect()) == key(stages[-1][2])


@pytest.mark.parametrize("at", range(5))
def test_awkward_rows_and_empty_tables(spark, data, at):
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, "no id at all here", None, None, None), (4, "x" * 20000, "de", "b", 0), (5, "word " * 20000, "en", "a", 100000),
        (6, "one two three", "en", "b", 13), (6, "one two three", "en", "b", 13), (7, "123 456", "fr", "c", 7), (8, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit(9)).withColumn("score", F.lit("clash")).withColumn("uid", F.lit(0))
    name, stage = P.STAGES[at]
    found = stage(spark, docs, data).collect()
    assert len(found) <= (2 if name == "mixing" else 1) * len(rows)
    if name == "language ID":
        assert not {r.doc_id for r in found} & {1, 2, 3, 7, 8}
    if name == "SimHash near-dedup":
        assert sorted((r.doc_id or 0) for r in found) == [0, 1, 4, 5, 6, 7]
    assert stage(spark, docs.limit(0), data).count() == 0


def test_training_uses_no_held_out_row(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    again = langid.train(docs.where(~langid.held_out()).withColumn("doc_id", F.lit(0)))
    assert (model.ratio == again.ratio).all()
