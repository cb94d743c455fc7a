"""The operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.llm import ann, bpe, chat, langid, line_dedup, mixing, quality, simhash, toxicity, warc
from landloom.llm.common import Scratch, shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "this line is certainly longer than forty characters in all"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a clashing extra column."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t\n", None, None, 3), (4, "x" * 30000, "de", "b", 30000),
        (5, "word " * 20000, "en", "a", 100000), (6, "one two three", "en", "b", 13), (6, "one two three", "en", "b", 13),
        (None, "no id here at all", "en", None, None), (7, "123 456 !!", "fr", "c", 10),
        *[(10 + i, f"{SHARED}\nown line {i}\n  {SHARED.upper()} ", "en", "c", 9) for i in range(6)],
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("n_lines", F.lit(1))


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_warc_round_trip(spark):
    rows = [(1, "http://a", b"x" * 2000), (5, None, b"x" * 2000), (3, "u\r\nX: y", b"x" * 2000), (4, "u", b"s"), (7, "u", b"s"), (8, "u", None), (None, "n", b"x" * 2000), (5, None, b"x" * 2000)]
    df = spark.createDataFrame(rows, "record_id long, uri string, payload binary").withColumn("size", F.lit(0))
    path = shared_path(spark, "warc")
    warc.write_archive(df, path)
    found = warc.read_archive(spark, path).collect()
    assert collections.Counter((r.record_id, r.record_type, r.refers_to) for r in found) == collections.Counter(
        [(1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5), (5, "response", None), (5, "response", None), (4, "response", None), (7, "response", None), (8, "response", None)]
    )
    payload = {i: p or b"" for i, _, p in rows}
    for r in found:
        assert r.payload_digest == hashlib.sha1(payload[r.record_id]).hexdigest() and r.payload_bytes == len(payload[r.record_id])
        ((header, block),) = warc.parse_warc(r.record)
        assert block.endswith(payload[r.record_id]) or r.record_type == "revisit"
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    empty = shared_path(spark, "warc")
    warc.write_archive(df.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_block_search_stops_early_and_finds_most():
    """Recall and the share of verified vectors of one block under a tree of several levels."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32)) * 2
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    proj = ann.Projection(32, 1.0)
    block = ann.Block(proj, np.arange(4000), x)
    assert len(block.starts) == 128
    hits = verified = 0
    for i in range(0, 4000, 50):
        ids, score, n = block.search(x[i], i, 20, -np.inf, ann.chi2_quantile(0.95, ann.DIMS))
        s = x @ x[i]
        s[i] = -np.inf
        want = np.lexsort((np.arange(4000), -s))[:20]
        hits, verified = hits + len(set(want) & set(ids)), verified + n
        assert np.allclose(score, s[ids]) and (np.diff(score) <= 0).all()
    print(f"recall {hits / 1600:.3f}, verified {verified / 80 / 4000:.3f} of all vectors")
    assert hits >= 0.93 * 1600 and verified < 0.25 * 80 * 4000


def test_block_of_few_vectors_and_few_rounds(monkeypatch):
    """A block of fewer vectors than asked for gives all of them; a block without clusters sorts its pool a few times, not once for every few leaves."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    proj = ann.Projection(64, float(np.sqrt((x * x).sum(1)).max()))
    limit = ann.chi2_quantile(0.95, ann.DIMS)
    ids, score, n = ann.Block(proj, np.arange(7), x[:7]).search(x[0], 0, 20, -np.inf, limit)
    assert sorted(ids) == [1, 2, 3, 4, 5, 6] and list(score) == [(x[i] * x[0]).sum() for i in ids] and n == 7
    block, sorts = ann.Block(proj, np.arange(4000), x), []
    real = np.argsort
    monkeypatch.setattr(ann.np, "argsort", lambda *a, **b: sorts.append(1) or real(*a, **b))
    block.search(x[0], 0, 20, -np.inf, limit)
    assert len(sorts) <= 6


@pytest.mark.parametrize("block", [200, 4096])
def test_nearest_against_brute_force(spark, block, monkeypatch):
    """One cell, and a tree of cells above the blocks."""
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:10]
        hits += len({v for v, _ in got[q]} & set(want))
        assert all(abs(v - s[i]) < 1e-12 for i, v in got[q])
    assert hits >= 0.9 * 10 * 150
    assert [v for v, _ in got[120]][:3] == [v for v in range(100, 104) if v != 120][:3] or x[120] @ x[120] < max((x * x[120]).sum(1))


def test_nearest_on_odd_rows(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(45)] + [(100, [0.0, 0.0]), (120, [float("nan"), 1.0]), (140, [1.0]), (None, [1.0, 2.0]), (160, None), (180, [None, 1.0]), (20, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 2), (20, 2, 5), (20, 3, 8), (40, 1, 2), (40, 2, 5), (40, 3, 8)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_chat_round_trip_on_odd_rows(spark):
    rows = [(1, 0, "user", "a<\\|b"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (2, None, None, None), (None, 3, "a\nb<|nl|>", "<|"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 0, "assistant", "<\\\\|" * 3), (5, 1, "", "<|im_end"), (5, 2, "assistant", "|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((r or "", x or ""))
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_texts == [x for r, x in turns if r == "assistant"]
        at = 0
        for s in got[c].segments:
            at += s.skip + s.size + len("<|im_end|>\n")
        assert at == len(got[c].formatted)
    assert got[3].escaped == 0 and got[1].escaped == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_counts(t):
    w = WORD.findall(t or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, documents, odd, data):
    for docs in (documents, odd):
        texts = collections.defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(brute_counts(r.text))
        for r in quality.judge(docs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    judged = quality.judge(documents).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert np.mean([r.quality == int(r.kept) for r in judged]) > 0.93
    assert quality.judge(documents.limit(0)).count() == 0


def test_repeated_words_by_brute_force():
    random.seed(3)
    for _ in range(300):
        t = " ".join(random.choice("ab" if random.random() < 0.5 else "abcdefgh") for _ in range(random.randint(0, 120)))
        assert quality.repeated_words(t.encode().split()) == brute_counts(t)[4]


def test_language_held_out(spark, documents, odd):
    model = langid.train(documents.where(~langid.held_out()))
    found = langid.identify(documents.where(langid.held_out()), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    by = {(r.doc_id, r.text): r for r in langid.identify(odd, model).collect()}
    assert by[(1, None)].lang_pred == by[(7, "123 456 !!")].lang_pred == "und" and by[(1, None)].ambiguous
    none = langid.train(documents.limit(0))
    assert {r.lang_pred for r in langid.identify(documents.limit(3), none).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12):
        m = langid.codewords(n)
        assert min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 4 else 4)


def test_toxicity_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = toxicity.learn(docs, labels.where(~langid.held_out()))
    found = toxicity.score(docs.where(langid.held_out()).select("doc_id", "text"), lexicon).join(labels, "doc_id").collect()
    assert np.mean([r.toxic == r.predicted for r in found]) > 0.93
    scored = toxicity.score(odd, lexicon).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    bare = toxicity.learn(docs.limit(0), labels.limit(0))
    assert bare.score("you st0pid clown") < bare.score("you stup1d wоrthless moron")
    assert bare.measures("a pond scum sample") == (0.0, 0.0)


def brute_hits(lexicon, text):
    """Hits word by word, with the longest term of each and no automaton."""
    folded = toxicity.fold(text)
    spans = [(i, i + len(p) - 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    found = []
    for i in range(len(folded)):
        terms = [t for t in lexicon.weights if folded.startswith(t, i)]
        if terms:
            found.append((i, lexicon.weights[max(terms, key=len)], any(a <= i < b for a, b in spans)))
    return found


def test_toxicity_scores_by_brute_force():
    random.seed(6)
    lexicon = toxicity.Lexicon({" idi": 2.0, " moron ": 3.0, " scum": 1.0, " sc": 0.5, " " + "z" * 40 + " ": 4.0}, exceptions=("pond scum", "scum pond idi", "sore loser", "the moron test"))
    words = ["idiot", "moron", "morons", "scum", "pond", "sc4m", "the", "test", "idi", "z" * 40, "z" * 41, "sore", "loser", "$cum", "@@@@@idiot"]
    for _ in range(300):
        text = " ".join(random.choice(words) for _ in range(random.randint(0, 25)))
        assert lexicon.hits(toxicity.fold(text)) == brute_hits(lexicon, text)
        total = sum(w for _, w, spared in brute_hits(lexicon, text) if not spared)
        assert lexicon.measures(text)[0] == pytest.approx(np.log1p(total))


def test_toxicity_learns_exceptions_and_long_words(spark):
    long_ = "q" * 60
    docs = [(i, "some plain words " + ("vermin people here" if i % 2 else "vermin control office" if i % 20 == 0 else "a day out")) for i in range(400)]
    docs += [(1000 + i, f"a text with {long_} in it") for i in range(60)] + [(1000, f"a text with {long_} in it")] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000 + i, 1) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(frame, labels)
    assert any(long_.startswith(t.strip()) for t in lexicon.weights) and not {f" {long_[:n]} " for n in range(1, 60)} & set(lexicon.weights)
    assert f" {long_} " in toxicity.terms_of(f" {long_} ", {}) and f" {long_[:30]}" in toxicity.terms_of(f" {long_} ", {long_[:24]: [long_[:30]]})
    assert any("vermin control" in p for p in lexicon.exceptions)
    assert lexicon.measures("call vermin control now") == (0.0, 0.0) and lexicon.score("vermin people") > 0.7 > lexicon.score("vermin control")
    assert toxicity.score(frame.limit(0), lexicon).count() == 0


def test_fold():
    assert toxicity.fold("$$$$$$tupid @@@@@@@ $$$").split()[0].endswith("sstupid")
    assert toxicity.fold("1D10T $tupid п3т idiot$$$ 4785").split()[:4] == ["idiot", "stupid", "пet", "idiot"]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_toxicity_counts_an_id_once(spark):
    """Rows that repeat one toxic id thousands of times change no term."""
    rng = random.Random(5)
    plain = "here plain thing words some other talk about nothing much today".split()
    rows = [(i, " ".join(rng.choices(plain, k=12)) + (" vilecretin" if i % 2 else "")) for i in range(1, 41)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, toxic int")
    once = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = toxicity.learn(spark.createDataFrame(rows + [rows[0]] * 4000, "doc_id long, text string"), labels)
    assert once.weights == often.weights and once.curve == often.curve and once.exceptions == often.exceptions
    assert any(t.strip().startswith("vile") for t in once.weights) and not set(plain) & {t.strip() for t in often.weights}


def test_toxicity_learns_beginnings_of_any_length(spark):
    """Words that share 40 letters, toxic with some endings; their first 24 letters are as common in clean texts."""
    start, rng = "x" * 12 + "abcdefghijklmnopqrstuvwxyzab", random.Random(6)
    end = lambda: "".join(rng.choices("abcdefghij", k=9))
    rows = [(i, f"some words here {start + end() if i % 2 else start[:28] + end()} and there") for i in range(1, 121)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 121)], "doc_id long, toxic int")
    weights = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels).weights
    long_ = [t for t in weights if len(t.strip()) > 24]
    assert len(long_) == 1 and start.startswith(long_[0].strip()) and 28 < len(long_[0].strip()) <= 40
    assert toxicity.long_beginnings(spark.createDataFrame([(None, 1), ("", 0)], "text string, toxic int"), 2) == {}


def test_language_samples_are_bounded(spark, monkeypatch):
    """A text repeated very often is one text of the sample, whichever way its hash falls."""
    monkeypatch.setattr(langid, "MEASURED", 30)
    texts = [(f"das ist ein satz nummer {i} von vielen", "de") for i in range(200)] + [(f"this is sentence number {i} of many", "en") for i in range(200)]
    frame = spark.createDataFrame(texts + [("immer wieder der gleiche text", "de")] * 5000, "text string, lang string")
    model, plain = langid.train(frame), langid.train(frame.distinct())
    assert model.languages == plain.languages == ["de", "en"] and (model.weight > 0).all()


def test_extra_columns_with_maps_and_dots(spark):
    docs = spark.createDataFrame([(i, f"{SHARED}\nline {i}", "a") for i in range(8)], "doc_id long, text string, source string")
    docs = docs.withColumn("a.b", F.lit("x")).withColumn("m", F.create_map(F.lit("k"), F.array("doc_id")))
    mixed = mixing.mix_documents(docs)
    assert set(mixed.columns) >= {"a.b", "m"} and mixed.count() > 0
    done = line_dedup.dedup_lines(docs)
    assert done.columns[:5] == docs.columns and sorted(r["n_dropped"] for r in done.collect()) == [0] + [1] * 7
    assert all(r["a.b"] == "x" and r["m"] == {"k": [r["doc_id"]]} for r in done.collect())


def test_bpe_tree_concatenation(vocabulary):
    c, al = bpe.codec(vocabulary), ["abcdefghijklmnopqrstuvwxyz", "the in an er on", "éàüß", "0123", "!?.,;:", "日本語", "İſǅ", "́\x1c\x85", "<|endoftext|>"]
    random.seed(1)
    for n in range(500):
        s = "".join(random.choice(random.choice(al[:1] * 4 + al)) for _ in range(random.randint(1, 300)))
        s = s.replace(" ", "") if n % 3 == 0 else s + "<|endoftext|>" + s[:20]
        ids = []
        for chunk in WORD.findall(s):
            for w, special in c.words(chunk):
                cut = bpe.halves(w, 3)
                ids += [special] if special is not None else c.tree([c.encode_part(x, k + 1 == len(cut)) for k, x in enumerate(cut)])
        want = c.whole.encode(s, add_special_tokens=False).ids
        assert ids == want and c.decode(ids) == c.whole.decode(want, skip_special_tokens=False)


def test_bpe_leaves_cut_anywhere(vocabulary):
    """Texts halved down to a few characters: every border may tear a word, a character's marks or a special token. Windows grow by need."""
    c, al = bpe.codec(vocabulary), ["abcdefghijklmnopqrstuvwxyz", "the in an er on", "éàüß", "0123", "!?.,;:'s", "日本語", "İſǅ", "\u0301\x1c\x85", "<|endoftext|>", " \t\n\u3000"]
    random.seed(4)
    c.windows.clear()
    for n in range(500):
        s = "".join(random.choice(random.choice(al + al[-1:] * 3)) for _ in range(random.randint(1, 400)))
        if n % 3 == 0:
            s = "<|endoftext|>".join(s[k : k + 20] for k in range(0, len(s), 20))
        cut = bpe.halves(s, random.choice([1, 2, 5, 30]))
        ids = bpe.join_all(c, bpe.leaf_pieces(c, cut))
        assert ids.tolist() == c.whole.encode(s, add_special_tokens=False).ids
    assert sum(c.windows.values()) > 10_000 and min(c.windows) == 1 and max(c.windows) >= 8
    assert sum(n for size, n in c.windows.items() if size > 1) > 0.2 * sum(c.windows.values())


def test_bpe_windows_over_prose(documents, vocabulary):
    """Borders inside words of real texts: most windows grow past the first, few far, and a piece keeps little text."""
    c = bpe.codec(vocabulary)
    c.windows.clear()
    for r in documents.where("length(text) > 900").limit(60).collect():
        pieces = bpe.leaf_pieces(c, bpe.halves(r.text, 400))
        assert all(sum(len(x.text or "") for x in p) <= 400 for p in pieces) and any(len(p) == 3 for p in pieces)
        assert bpe.join_all(c, pieces).tolist() == c.whole.encode(r.text, add_special_tokens=False).ids
    total = sum(c.windows.values())
    assert c.windows[1] < 0.9 * total and sum(n for size, n in c.windows.items() if size > 64) < 0.05 * total


def test_bpe_long_texts_take_the_tree(spark, documents, vocabulary):
    """Every text longer than a leaf is cut into leaves, and the leaves make the ids of the whole."""
    want = {r.doc_id: r.n_tokens for r in bpe.encode(documents, vocabulary, leaf=10**9).collect()}
    assert {r.doc_id: r.n_tokens for r in bpe.encode(documents, vocabulary, leaf=500).collect()} == want
    cut = bpe.long_leaves(documents.select("doc_id", "text"), vocabulary, 500)
    rows = cut.groupBy("row").agg(F.count("*").alias("leaves"), F.sum(F.char_length("text")).alias("n")).collect()
    long_ = [r for r in documents.collect() if len(r.text or "") > 500]
    assert len(rows) == len(long_) > 50 and sorted(r.n for r in rows) == sorted(len(r.text) for r in long_)
    assert all(r.leaves >= 2 for r in rows)


def test_bpe_of_documents(spark, documents, odd, vocabulary):
    c = bpe.codec(vocabulary)
    extra = spark.createDataFrame([(90, "abc " * 10 + "x" * 30000 + " the end"), (91, "héllo" * 4000), (92, "<|endoftext|>" + "ab1" * 9000 + "<|startoftext|>, it's"), (93, "a" * 8192), (94, "a\x1cb c")], "doc_id long, text string")
    for docs in (documents.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        found = bpe.encode(docs, vocabulary).collect()
        assert len(found) == docs.count()
        for r in found:
            want = c.whole.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.ids, r.n_tokens) == (" ".join(map(str, want)), len(want))
            assert r.decoded == c.whole.decode(want, skip_special_tokens=False)
    assert bpe.encode(documents.limit(0), vocabulary).count() == 0


def test_bpe_of_long_texts_without_words(spark, vocabulary):
    texts = [(i, ch * n) for i, (ch, n) in enumerate((c, n) for c in "\u00a0\u3000\x85" for n in (8192, 8193, 9000))]
    docs = spark.createDataFrame([*texts, (50, "\u3000" * 9000 + " a")], "doc_id long, text string")
    found = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in bpe.encode(docs, vocabulary).collect()}
    assert len(found) == 10 and found.pop(50)[0] == 1
    assert set(found.values()) == {(0, "", "")}
    digests = {r.ids_sha256 for r in bpe.encode(docs.where("doc_id < 50"), vocabulary, with_ids=False).collect()}
    assert digests == {hashlib.sha256(b"").hexdigest()}


def test_mixing_meets_targets(spark, documents, odd):
    for docs in (documents, odd):
        got = mixing.mix(docs).toPandas()
        again = mixing.mix(docs).toPandas()
        key = ["uid", "copies", "size"]
        assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
        assert len(got) == docs.count() and got.copies.between(0, 2).all()
        assert sorted(got["size"]) == sorted(len(WORD.findall(r.text or "")) for r in docs.collect())
        sources = docs.groupBy("source").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("t")).collect()
        size = {r.source: sum(len(WORD.findall(t)) for t in r.t) for r in sources}
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, free, left = {}, set(order), 1.5 * sum(size.values())
        while free:
            total = sum(weight[s] for s in free)
            over = [s for s in free if left * weight[s] / total > 2 * size[s] + 1e-9]
            if not over:
                target |= {s: left * weight[s] / total for s in free}
                break
            for s in over:
                target[s] = 2 * size[s]
                left -= 2 * size[s]
                free.discard(s)
        assert np.allclose(sorted(set(round(t, 6) for t in target.values())), sorted(set(got.target.round(6))))
        for t, part in got.groupby(got.target.round(6)):
            assert abs((part["size"] * part.copies).sum() - sum(v for v in target.values() if round(v, 6) == t)) <= part["size"].max()
    assert mixing.mix(documents.limit(0)).count() == 0


def test_mixed_documents_repeat_as_taken(spark, odd):
    n = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(odd).count() == n


def brute_lines(rows, min_docs=5):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if d is None else d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= min_docs}
    return sorted("\n".join(x for x in (t or "").split("\n") if gone.get(key(x), -9) in (-9, -1 if d is None else d)) for d, t in rows)


def test_line_dedup_by_brute_force(spark, documents, odd):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = line_dedup.dedup_lines(docs)
        assert sorted(r.text for r in got.collect()) == brute_lines(rows)
        assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(documents.limit(0)).count() == 0


def test_line_keys_keep_an_f_and_lose_a_form_feed(spark):
    ends, begins, fed = "a line of exactly forty code points itsf", "f line of exactly forty code points its.", "this copy ends or begins with a form feed, and no more"
    assert len(ends) == len(begins) == 40
    stem = "lines of this stem differ by no more than one letter o"
    rows = [(i, "\n".join([ends, begins, stem + "f" * (i % 2), ("\f" * (i % 2) + fed + "\f" * (i % 3)), f"own {i}"])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    assert [t for t, _, _ in got] == brute_lines(rows)
    # each stem is held by four documents only, so it stays
    assert sum(d for _, _, d in got) == 3 * 7


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5, 0, -1):
        runs.add(spark.createDataFrame([(b, 1, 1), (b, 1, 1), (b, b, b)], "doc long, h1 long, h2 long"))
    assert sum(map(len, runs.levels)) == 2
    assert [tuple(r) for r in runs.common(5).collect()] == [(1, 1, 5)]
    # entries of all runs meet without a new shuffle, and one entry of each key has a keeper
    plan = runs.common(5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sorted(r.h1 for r in runs.entries().where("keeper is not null").collect()) == [1, 2, 3, 4, 5]
    runs.close()
    assert not runs.paths


def test_mixing_of_many_equal_rows(spark):
    """Equal rows are one unit: each gets its share, and the whole meets the target."""
    rows = [(1, "one two three four", "a")] * 10_000 + [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.doc_id == 1).sum() == 10_000
    same = got[got.doc_id == 1].copies
    assert same.max() - same.min() <= 1 and got.copies.between(0, 2).all()
    for _, part in got.groupby("target"):
        assert abs((part["size"] * part.copies).sum() - part.target.iloc[0]) <= part["size"].max()
    mixed = mixing.mix_documents(docs).groupBy("doc_id").count().collect()
    want = got.groupby("doc_id").copies.sum()
    assert {r.doc_id: r["count"] for r in mixed} == {d: c for d, c in want.items() if c}


def test_golay_balls_share_keys():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**63, 2000).astype(np.uint64)
    other = fp ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    a, b = (set(zip(r.tolist(), k.tolist())) for r, k in (simhash._keys(fp, False), simhash._keys(other, True)))
    assert len({r for r, _ in a & b}) == 2000


def brute_components(ids, fps):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b, g in zip(ids[:i], fps[:i]):
            if (fps[i] ^ g).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, documents):
    import xxhash

    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    fps = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    want = brute_components([i for i, _ in rows], fps)
    for r in simhash.near_duplicates(documents).collect():
        i = [d for d, _ in rows].index(r.doc_id)
        assert r.fp % 2**64 == fps[i] and r.component_id == want[r.doc_id]


def test_simhash_crowded_buckets_are_exact(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 64, (150, 3))})
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "node long, fp long")
    with Scratch(spark, "crowded") as kept:
        got = {r.node: r.component for r in simhash.components(simhash.links(df, kept), df.select("node")).collect()}
    assert got == brute_components(list(range(len(fps))), fps)


def test_simhash_on_odd_rows(spark, odd):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (None, None), (6, 6)} <= got
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = [r.doc_id for r in simhash.drop_near_duplicates(odd).collect()]
    assert 2 not in kept and kept.count(6) == 1
