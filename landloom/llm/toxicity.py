"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, homoglyphs, digits standing for letters), reduced to words of
letters, and scanned once by an Aho-Corasick automaton that holds lexicon terms and exception phrases.
A term is anchored at the start of a word and may stop short of its end, so that one entry covers its
endings. Hits inside an exception phrase do not count. The sum of the weights and its share of the text's
length give the score through a logistic curve.

Terms, exception phrases, weights and the curve are learned from a bounded sample of labelled rows: a phrase of two words
spares its term if clean texts hold it and toxic ones do not.
"""

from __future__ import annotations

import math
import os
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .langid import held_out

#: At most this many labelled rows of either label are learned from.
LEARNED = 3000
#: Beginnings of up to this many letters are counted at once; longer ones only where different words share them.
STEM = 24
#: Characters that look like a letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
#: Digits and signs that stand for a letter inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Terms known beforehand, with the weight they have until labels say more.
SEED_TERMS = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "worthless")
SEED_WEIGHT = 3.0
#: Steps to one for the measures that the curve is fitted on.
GRID = 50
#: Harmless phrases that hold a term, known beforehand.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "stupid question", "idiot proof", "pond scum", "sore loser")


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point to folded code point; what is not a letter becomes a blank."""
    to = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    for a, b in {**HOMOGLYPHS, **SUBSTITUTES}.items():
        to[ord(a)] = ord(b)
    return to


def fold(text: str) -> str:
    """The folded text: words of letters between single or more blanks, with a blank at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _fold_table()[cp]
    # digits and signs count as letters only right before or after a real one
    sign = (out != 32) & (cp < 128) & ~((cp >= 97) & (cp <= 122))
    if sign.any():
        real = (out != 32) & ~sign
        near = np.zeros_like(real)
        near[1:] |= real[:-1]
        near[:-1] |= real[1:]
        money = (cp == 36) | (cp == 64)
        # a run of $ or @ leads a word if the character after the run is a letter; the text ends with a blank
        after = np.minimum.accumulate(np.where(money, len(cp) - 1, np.arange(len(cp)))[::-1])[::-1]
        leads = money & real[after]
        out = np.where(sign & np.where(money, ~leads, ~near), np.uint32(32), out)
    return out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def terms_of(folded: str, longer: dict[str, list[str]], least: int = 4) -> set[str]:
    """Candidate terms of a text: each whole word, closed by a blank, its beginnings of ``least`` to STEM letters, and those in ``longer``, by their first STEM letters."""
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in range(least, min(len(w), STEM) + 1))
        found.update(f" {t}" for t in longer.get(w[:STEM], ()) if w.startswith(t))
    return found


class Lexicon:
    """Weighted terms, exception phrases and the curve of the score."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] = (-4.0, 1.0, 1.0), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.curve, self._automaton = weights, curve, None
        self.exceptions = tuple(f" {' '.join(fold(p).split())} " for p in exceptions)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for p in self.exceptions:
                a.add_word(p, (len(p), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, float, bool]]:
        """Start, weight and whether an exception spares it, of the longest term of every word that has one."""
        a = self.automaton()
        if not len(a):
            return []
        terms, spared = [], []
        for end, (size, weight) in a.iter(folded):
            (spared if weight is None else terms).append((end - size + 1, end, weight))
        found, at, last, j = [], -1, -1, 0
        spared.sort(key=lambda x: x[0])
        for start, _, weight in sorted(terms, key=lambda x: (x[0], -x[1])):
            if start == at:
                continue
            at = start
            while j < len(spared) and spared[j][0] <= start:  # the farthest end of the phrases begun so far
                last = max(last, spared[j][1])
                j += 1
            found.append((start, weight, start < last))
        return found

    def measures(self, text: str | None) -> tuple[float, float]:
        """Log of the summed weight of all counted hits, and of that weight per hundred words."""
        folded = fold(text or "")
        total = sum(w for _, w, spared in self.hits(folded) if not spared)
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 1))

    def phrases(self, text: str | None) -> set[str]:
        """The phrases of two words around every counted hit: with the word before, and with the word after."""
        folded = fold(text or "")
        words, starts = folded.split(), []
        at = 0
        for w in words:
            at = folded.index(w, at)
            starts.append(at - 1)
            at += len(w)
        number, found = {s: i for i, s in enumerate(starts)}, set()
        for start, _, spared in self.hits(folded):
            i = number.get(start)
            if not spared and i is not None:
                found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j and j + 2 <= len(words))
        return found

    def score(self, text: str | None) -> float:
        x, y = self.measures(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x + c * y))))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve by Newton's method; slopes are kept from falling below zero."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(3)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.05 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    if (beta[1:] < 0).any():
        return (-4.0, 1.0, 1.0)
    return tuple(float(b) for b in beta)


def chosen(candidates: list[tuple[str, float]]) -> dict[str, float]:
    """The weights of candidates in the order given, as long as no taken term begins with one or it with a taken one."""
    weights: dict[str, float] = {}
    beginnings: set[str] = set()
    for term, weight in candidates:
        own = [term[:n] for n in range(1, len(term) + 1)]
        if term not in beginnings and not any(o in weights for o in own):
            weights[term] = weight
            beginnings.update(own)
    return weights


def learn(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Lexicon:
    """A lexicon from labelled rows: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic 0/1).

    At most LEARNED doc_ids of either label are used, chosen by a hash of doc_id, with one text each: the smallest where rows
    repeat an id. Null labels and ids are skipped, an id with both labels counts as toxic, a null or empty text has no terms. A
    term is taken if it marks toxic texts: by falling log-likelihood ratio, as long as no taken term begins
    with it or it with a taken one. Its weight is the log of how much likelier it is in a toxic text. Then phrases of two words around
    its hits that clean texts hold, and toxic ones next to never, become exceptions. Without labels of both kinds, empty tables
    included, the terms known beforehand stand alone. Other columns are ignored.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not share.get(1) or not share.get(0):
        return Lexicon({f" {t}": SEED_WEIGHT for t in SEED_TERMS})
    order = F.xxhash64(F.lit(seed), "doc_id")
    # two top-n cuts of ids: at most 2 * LEARNED rows, which is what the broadcast holds
    drawn = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(LEARNED) for t in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    with Scratch(docs.sparkSession, "toxicity") as kept:
        sample = kept.table(sample.select("text", "toxic").repartition(64), "labelled")
        size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not size.get(1) or not size.get(0):
            return Lexicon({f" {t}": SEED_WEIGHT for t in SEED_TERMS})
        return _learn(sample, share, size)


def long_beginnings(sample: DataFrame, support: int) -> dict[str, list[str]]:
    """Beginnings of more than STEM letters where words of the sample (``text, toxic``) part, by their first STEM letters.

    Neighbours among the sorted words that share STEM letters part at all beginnings worth counting: a longer one stands for the same words
    as the next of these. Those that at least ``support`` toxic texts can hold come back; each needs as many words or texts.
    """

    def words(batches):
        for b in batches:
            rows = [(w[:STEM], w, toxic) for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(fold(text or "").split()) if len(w) > STEM]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["stem", "word", "toxic"])

    def parting(batches):
        for b in batches:
            stems, shared = b.column(0).to_pylist(), [os.path.commonprefix(p) for p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            rows = [(s, t) for s, t in zip(stems, shared) if len(t) > STEM]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["stem", "term"])

    held = sample.mapInArrow(words, "stem string, word string, toxic int").groupBy("stem", "word").agg(F.sum("toxic").alias("t"))
    pairs = held.withColumn("before", F.lag("word").over(Window.partitionBy("stem").orderBy("word"))).where("before is not null").select("stem", "word", "before")
    terms = pairs.mapInArrow(parting, "stem string, term string").distinct()
    enough = terms.join(held, "stem").where(F.startswith("word", "term")).groupBy("stem", "term").agg(F.sum("t").alias("t")).where(F.col("t") >= support)
    found: dict[str, list[str]] = {}
    for r in enough.select("stem", "term").toArrow().to_pylist():
        found.setdefault(r["stem"], []).append(r["term"])
    return found


def _learn(sample: DataFrame, share: dict[int, int], size: dict[int, int]) -> Lexicon:
    def counted(found_in):
        """``term, t, c``: how many toxic and clean texts of the sample hold each term."""

        def count(batches):
            seen = (Counter(), Counter())
            for b in batches:
                for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seen[toxic].update(found_in(text))
            terms = [*seen[0].keys() | seen[1].keys()]
            yield pa.record_batch([pa.array(terms, pa.string()), *(pa.array([seen[x][t] for t in terms], pa.int64()) for x in (1, 0))], names=["term", "t", "c"])

        return sample.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    T, C = size[1], size[0]
    longer = long_beginnings(sample, max(2, T // 200))
    ratio = F.log((F.col("t") + 0.5) / (T + 1)) - F.log((F.col("c") + 0.5) / (C + 1))
    marks = counted(lambda text: terms_of(fold(text or ""), longer)).where((F.col("t") >= max(2, T // 200)) & (ratio > 1.5))
    found = marks.select("term", ratio.alias("w"), (F.col("t") * ratio).alias("gain")).toArrow().to_pylist()
    found.sort(key=lambda r: (-r["gain"], r["term"]))
    weights = chosen([(r["term"], r["w"]) for r in found])
    for t in SEED_TERMS:
        if not any(f" {t} ".startswith(k) or k.startswith(f" {t}") for k in weights):
            weights[f" {t}"] = SEED_WEIGHT
    first = Lexicon(weights)
    harmless = counted(first.phrases).where((F.col("c") >= max(2, C // 500)) & (ratio < -1.5)).select("term").toArrow().column(0).to_pylist()
    lexicon = Lexicon(weights, exceptions=EXCEPTIONS + tuple(sorted(harmless)))

    def measured(batches):
        for b in batches:
            m = np.array([lexicon.measures(t) for t in b.column(0).to_pylist()], float).reshape(-1, 2)
            yield pa.record_batch([*map(pa.array, np.round(m * GRID).astype(np.int64).T.copy()), b.column(1)], names=["x", "y", "toxic"])

    # both measures are logs, so a grid over them has few cells, whatever the number of rows
    cells = sample.mapInArrow(measured, "x long, y long, toxic int").groupBy("x", "y", "toxic").agg(F.count("*").alias("n")).collect()
    m = np.array(sorted((r["x"] / GRID, r["y"] / GRID, r["toxic"], r["n"]) for r in cells), float).reshape(-1, 4)
    weight = m[:, 3] * np.where(m[:, 2] == 1, share[1] / T, share[0] / C)
    lexicon.curve = _fit(m[:, :2], m[:, 2], weight * m[:, 3].sum() / weight.sum())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) beside all other columns of ``docs``.

    Only ``text`` is read, whole at any length, in one task. A null or empty text has no hits and gets the lowest score. Repeated
    rows get the same answer; columns of ``docs`` named ``score`` or ``predicted`` are replaced. An empty table gives none.
    """
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])

    def run(batches):
        for b in batches:
            s = np.array([lexicon.score(t.as_py()) for t in b.column("text")], float)
            cells = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.record_batch([*b.columns, *cells], names=[*b.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``, from a lexicon learned from ``labels`` that are not held out; rows as ``score`` defines them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), lexicon).select("doc_id", "held_out", "score", "predicted")
