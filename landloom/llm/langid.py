"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier on hashed character trigrams,
trained on all labelled rows, says which side a text is on: its output is the mean log-likelihood ratio
of the text's trigrams between the languages with that bit set and the others. Decoding weighs the
loss of every bit by how often its classifier is right for the language in question (measured on a
bounded sample) and takes the language with the least loss; a close runner-up flags the result as ambiguous.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hashed trigrams; a power of two.
GRAMS = 1 << 14
#: At most about this many labelled rows per language measure the bit classifiers.
MEASURED = 400


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after the other, and how many each text has.

    Letters are lower-cased, everything else is a blank, and only trigrams around a letter count.
    """
    raw = "".join(f"  {t.lower()}  " for t in texts).encode("utf-32-le", "surrogatepass")
    cp = np.frombuffer(raw, np.uint32)
    sizes = np.array([len(t.lower()) + 4 for t in texts], np.int64)
    letter = _letters()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    mid = letter[1:-1]
    a, b, c = cp[:-2][mid], cp[1:-1][mid], cp[2:][mid]
    h = (a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ c * np.uint32(3266489917)) * np.uint32(668265263)
    per_text = np.add.reduceat(letter, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64) if texts else np.zeros(0, np.int64)
    return (h >> np.uint32(18)).astype(np.int32), per_text


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """(languages, bits) of -1 and 1: all distinct splits for up to five languages, else a dense random
    code, the best of many by least distance between rows."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = [(1, *s) for s in product((1, -1), repeat=languages - 1)][1:]
        return np.array(splits, float).T
    bits, rng, best, found = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), -1, None
    for _ in range(500):
        m = rng.choice([-1.0, 1.0], (languages, bits))
        gap = min((m[i] != m[j]).sum() for i in range(languages) for j in range(i))
        if gap > best and (np.abs(m.sum(0)) < languages).all():
            best, found = gap, m
    return found


class Model:
    """Bit classifiers over ``languages``, from trigram counts by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1]) if len(languages) else np.ones((0, GRAMS))
        bits = self.code.shape[1] if len(languages) else 0
        self.ratio = np.zeros((bits, GRAMS), np.float32)
        for b in range(bits):
            one, other = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(one) and len(other):
                self.ratio[b] = np.log(one.mean(0) / other.mean(0))
        self.weight = np.ones_like(self.code)

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, bits) mean log-likelihood ratios, and the letters of each text."""
        h, n = grams(texts)
        out = np.zeros((len(texts), len(self.ratio)))
        some = np.nonzero(n)[0]
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])[some]
            for b, r in enumerate(self.ratio):
                out[some, b] = np.add.reduceat(r[h], starts, dtype=np.float64) / n[some]
        return out, n

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score in 0..1, and the gap to the runner-up."""
        loss = np.stack([(w * np.logaddexp(0, -2 * m * margins)).sum(1) / w.sum() for m, w in zip(self.code, self.weight)], 1)
        best = loss.argmin(1)
        p = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        score = 1 / p.sum(1)
        gap = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, gap


def _parts(batches, most: int = 2_000_000):
    """Slices of record batches with at most about ``most`` characters of text in column ``text``."""
    for b in batches:
        texts, start, size = b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > most or i + 1 == len(texts):
                yield b.slice(start, i + 1 - start), [x or "" for x in texts[start : i + 1]]
                start, size = i + 1, 0


def train(labelled: DataFrame, seed: int = 11) -> Model:
    """A model from ``text, lang`` rows; rows without text or language are skipped.

    Trigrams are counted over all rows; only (language, trigram) sums leave the tasks. At most about MEASURED
    rows per language, chosen by a hash of the text, weigh the bit classifiers.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part, texts in _parts(batches):
            h, n = grams(texts)
            ends = np.cumsum(n)
            for lang, lo, hi in zip(part.column("lang").to_pylist(), ends - n, ends):
                if lang not in sums:
                    sums[lang] = np.zeros(GRAMS, np.int64)
                if hi - lo < 4096:
                    np.add.at(sums[lang], h[lo:hi], 1)
                else:
                    sums[lang] += np.bincount(h[lo:hi], minlength=GRAMS)
        for lang, v in sums.items():
            at = np.nonzero(v)[0]
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(v[at])], names=["lang", "gram", "n"])

    found = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = found.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    counts = np.zeros((len(found), GRAMS))
    for i, r in enumerate(found):
        counts[i, r["grams"]] = r["ns"]
    model = Model([r["lang"] for r in found], counts)
    if len(found) > 1:
        # equal texts of a language are one: they are drawn together, and all but one are left out
        total = rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("of"))
        drawn = F.xxhash64(F.lit(seed), "text").bitwiseAND(F.lit(2**31 - 1)) < F.lit(float(MEASURED * 2**31)) / F.col("of")
        sample = rows.join(F.broadcast(total), "lang").where(drawn).select("lang", "text").distinct()

        def right(batches):
            for part, texts in _parts(batches):
                m, _ = model.margins(texts)
                lang = part.column("lang").to_pylist()
                code = model.code[[model.languages.index(x) for x in lang]]
                yield pa.record_batch([pa.array(lang, pa.string()), pa.array((m * code > 0).astype(float).tolist())], names=["lang", "ok"])

        marks = sample.mapInArrow(right, "lang string, ok array<double>").select("lang", F.posexplode("ok").alias("bit", "ok"))
        for r in marks.groupBy("lang", "bit").agg(F.avg("ok").alias("ok")).collect():
            model.weight[model.languages.index(r["lang"]), r["bit"]] = max(0.05, 2 * r["ok"] - 1)
    return model


def identify(docs: DataFrame, model: Model, ambiguous_below: float = 0.05) -> DataFrame:
    """``lang_pred, score, ambiguous`` beside all other columns of ``docs``.

    ``lang_pred`` is a language of the model, or ``und`` with score 0 for a text that is null or has no letter (or
    where the model has no language). ``ambiguous`` is set where the runner-up's loss is within
    ``ambiguous_below`` of the least. Only ``text`` is read. Rows that repeat get the same answer; a column of
    ``docs`` with one of the three names is replaced.
    """
    new = ["lang_pred", "score", "ambiguous"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in new])

    def run(batches):
        for part, texts in _parts(batches):
            m, n = model.margins(texts)
            best, score, gap = model.decode(m) if model.languages else (np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)))
            known = (n > 0) & bool(model.languages)
            lang = [model.languages[i] if k else "und" for i, k in zip(best, known)]
            cells = [pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (gap < ambiguous_below))]
            yield pa.record_batch([*part.columns, *cells], names=[*part.schema.names, *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    """Rows kept from training. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, from a model of the rows that are not held out; null and empty texts as ``identify`` defines them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    named = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(named, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
