"""Quality rules as weak supervision.

Every rule looks at a few counts of a document and votes good, votes bad or abstains. How often each
rule votes right on good and on bad documents, and how many documents are good, are estimated without labels
by expectation-maximisation over all documents; a document is kept if its posterior probability
of being good is at least one half. Votes take three values, so all documents reduce to at most
3 ** rules counted patterns; these counts (a few hundred rows at any corpus size) are the whole input of
the estimation, and posteriors join back by pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise, table

FEATURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "letters", "uppers", "n_marks", "n_function_words",
]
#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and to in is a that for it was on are as with be by this from at or an"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als"
    " de la le et les des en un du une que est pour qui dans sur par au pas"
    " el los y del se las por con para su lo al más".split()
)


_UPPER = bytes(range(65, 91))
_NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())


def repeated_words(words: list, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found at least twice.

    Hashes of windows show quickly that none repeats, since equal windows have equal hashes. Otherwise windows
    are compared exactly: words become numbers, and numbers of runs of twice the length follow from numbering
    pairs of numbers.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:n].copy()
    for k in range(1, width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < width:
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        ids, span = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * span
    at = np.nonzero(np.bincount(ids)[ids] > 1)[0]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features_of(text: str | None) -> list[int]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line and line.strip(ASCII_SPACE):
            dup += line in seen
            seen.add(line)
    return [
        len(words),
        len(text) - sum(text.count(c) for c in ASCII_SPACE),
        sum(text.count(c) for c in "#*$%&|<>"),
        dup,
        repeated_words(words),
        len(lines),
        len(text) - len(raw) + len(raw.translate(None, _NO_LETTER)),
        len(raw) - len(raw.translate(None, _UPPER)),
        text.count("!") + text.count("?"),
        sum(map(FUNCTION_WORDS.__contains__, text.lower().split())),
    ]


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, 2).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: 1 votes good, 2 votes bad, 0 abstains. Ratios are to words, letters or lines."""
    c = F.col
    per_word = lambda x: F.when(c("n_words") > 0, c(x) / c("n_words")).otherwise(0.0)
    symbols, marks, function, repeats = (per_word(x) for x in ("n_symbols", "n_marks", "n_function_words", "n_repeat_words"))
    symbol_chars = F.when(c("word_chars") > 0, c("n_symbols") / c("word_chars")).otherwise(0.0)
    length = per_word("word_chars")
    upper = F.when(c("letters") > 0, c("uppers") / c("letters")).otherwise(0.0)
    letters = F.when(c("word_chars") > 0, c("letters") / c("word_chars")).otherwise(0.0)
    dup = c("n_dup_lines") / c("n_lines")
    return {
        "symbols": _vote(symbols, symbols < 0.02, symbols > 0.1),
        "symbol_chars": _vote(symbol_chars, symbol_chars < 0.01, symbol_chars > 0.05),
        "uppercase": _vote(upper, upper < 0.15, upper > 0.3),
        "marks": _vote(marks, marks < 0.1, marks > 0.3),
        "function_words": _vote(function, function > 0.1, (function < 0.03) & (c("n_words") >= 20)),
        "word_length": _vote(length, length.between(3, 7), (length < 2.5) | (length > 10)),
        "letters": _vote(letters, letters > 0.85, letters < 0.7),
        "repeats": _vote(repeats, repeats < 0.02, repeats > 0.15),
        "dup_lines": _vote(dup, (c("n_dup_lines") == 0) & (c("n_lines") >= 3), dup > 0.3),
    }


def estimate(patterns: list[tuple[str, int]], rules: int, rounds: int = 200) -> dict[str, float]:
    """Posterior of "good" for each vote pattern by expectation-maximisation over counted patterns.

    A rule votes bad with one probability on good and another on bad documents, given that it votes; an
    abstention says nothing. Starts from "any bad vote means bad". Light Beta priors say that rules are right
    more often than wrong, which also fixes which class is which. Order of patterns does not matter.
    """
    if not patterns:
        return {}
    patterns = sorted(patterns)
    x = np.array([[int(v) for v in p] for p, _ in patterns])
    n = np.array([k for _, k in patterns], float)
    bad, good = x == 2, x == 1
    p = np.where(bad.any(1), 0.1, 0.95)
    for _ in range(rounds):
        w1, w0 = n * p, n * (1 - p)
        prior = (w1.sum() + 2) / (n.sum() + 4)
        bad1 = (w1 @ bad + 0.1) / (w1 @ (bad | good) + 10.0)
        bad0 = (w0 @ bad + 1.0) / (w0 @ (bad | good) + 4.0)
        logit = np.log(prior / (1 - prior)) + bad @ np.log(bad1 / bad0) + good @ np.log((1 - bad1) / (1 - bad0))
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return {k: float(v) for (k, _), v in zip(patterns, p)}


def judge(docs: DataFrame) -> DataFrame:
    """Counts, votes and verdict of every document.

    Returns ``doc_id``, the columns of FEATURES, ``votes`` (a digit per rule), ``p_good``, ``base_failed`` and ``kept``,
    one row per row of ``docs``. ``base_failed`` is set below 20 words or where over 30 % of the words repeat in
    8-word windows. A null text is an empty one; its counts are 0 and it fails the base rules. Repeated
    rows are judged each, a null ``doc_id`` stays, an empty table gives no row; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            rows = np.array([features_of(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES)
    )
    rules = votes()
    counted = counted.withColumn("votes", F.concat(*[v.cast("string") for v in rules.values()]))
    counted = materialise(counted, "quality-counts")
    patterns = [(r[0], r[1]) for r in counted.groupBy("votes").count().collect()]
    found = estimate(patterns, len(rules))
    # at most 3 ** rules rows, whatever the size of the corpus
    posterior = docs.sparkSession.createDataFrame(list(found.items()), "votes string, p_good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.join(F.broadcast(posterior), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= 0.5))
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the rules for every whole text of ``documents``; null, empty and very long texts and repeated rows as ``judge`` defines them."""
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
