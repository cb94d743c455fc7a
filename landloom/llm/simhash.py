"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded to 23). Two errors leave
at least one segment exact and, given an exact one, put at most one error into some other segment. So a
pair within two bits agrees, for some ordered pair of segments (i, j), exactly on i and within one bit on
j. The perfect Golay code [23, 12] turns "within one bit" into equal keys: every word decodes to one
codeword, and the words one bit away from a given word decode to at most six. One side of the join
carries the code index of segment j, the other the indices of its whole one-bit ball.

Buckets of few fingerprints are joined and their pairs verified by Hamming distance. A crowded bucket
would need all pairs, so its fingerprints are linked through the points of their one-bit balls
instead: two fingerprints are within two bits exactly if their balls share a point, and every
fingerprint of a shared point links to the smallest. That is exact and linear, so nothing is capped.

Only distinct fingerprints take part; documents come back through membership.

``near_duplicates`` is that, for fingerprints within two bits. ``similar_documents`` is for similarity of shingle sets,
0.8 and more, where fingerprints differ by more bits than a Golay search reaches: the same links bring the closest copies
together, a prefix filter on rare shingles finds all the others, and candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, materialise, small_batches, table

#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: A bucket with more fingerprints than this is linked through ball points.
CROWDED = 48


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator polynomial."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= ((r >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY << (bit - 11))
    return r


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """The error pattern of weight 3 or less for each of the 2048 syndromes."""
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    a, b = np.triu_indices(23, 1)
    two = one[a] | one[b]
    three = np.array([a | b | c for x, a in enumerate(one) for y, b in enumerate(one[x + 1 :], x + 1) for c in one[y + 1 :]], np.uint32)
    patterns = np.concatenate([np.zeros(1, np.uint32), one, two, three])
    found = np.zeros(2048, np.uint32)
    found[_syndrome(patterns)] = patterns
    return found


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _errors()[_syndrome(words)]) >> np.uint32(11)


def golay_ball(words: np.ndarray) -> np.ndarray:
    """(n, 24) indices that the words within one bit of each word decode to, repeats included."""
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(23, dtype=np.uint32)])
    return golay_index(words.astype(np.uint32)[:, None] ^ flips[None, :])


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(lo)) & np.uint64((1 << n) - 1) for lo, n in SEGMENTS]


def _keys(fp: np.ndarray, ball: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every ordered pair of segments; a key holds the pair, the exact bits and a code index."""
    segments, rows, keys = _segments(fp), [], []
    for j, fuzzy in enumerate(segments):
        index = golay_ball(fuzzy) if ball else golay_index(fuzzy)[:, None]
        index = np.sort(index, axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(new)
        for i, exact in enumerate(segments):
            if i != j:
                rows.append(row)
                keys.append((np.uint64(3 * i + j) << np.uint64(35)) | (exact[row] << np.uint64(12)) | index[row, col].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text in UTF-8, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()


def shingle_hashes(found: list[bytes], words: int, seed: int):
    """XXH64 of every word shingle, repeats included, a block of up to 65,536 at a time. Fewer words are one shingle."""
    import xxhash

    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    ends, digest = ends[-n:], xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        pairs = zip(starts[at : min(n, at + 65536)].tolist(), ends[at : at + 65536].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """SimHash of one whole text over its word shingles."""
    found = words_of(text)
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    return _bits(sum(_ones(h) for h in shingle_hashes(found, words, seed)), n)


def _bits(ones: np.ndarray, n: int) -> int:
    """The fingerprint: a bit is set if over half of ``n`` hashes have it."""
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            found = [fingerprint(t.as_py(), words, seed) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for all ``nodes``, from ``a, b`` edges.

    Alternates large-star and small-star steps, each one grouped minimum and one join, until the edges stay
    as they are. Every step's edges are a table in the shared folder.
    """
    with Scratch(edges.sparkSession, "components") as kept:
        found = materialise(_components(edges, kept), "components")
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def _components(edges: DataFrame, kept: Scratch) -> DataFrame:
    """``u, component`` for the nodes that have an edge."""

    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        """``df`` as a table, and a mark that changes with its rows."""
        seen = Observation()
        mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(2**40 - 1))).alias("h"))
        done = kept.table(df.observe(seen, *mark), "links")
        return done, tuple(seen.get.values())

    now, before = step(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = kept.table(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, after = step(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if after == before:
            return now.groupBy("u").agg(F.min("v").alias("component"))
        before = after


def links(classes: DataFrame, kept: Scratch) -> DataFrame:
    """``a, b`` links between ``node``s whose ``fp`` differ in one or two bits, enough to connect all of them."""

    def keys(ball: bool):
        def run(batches):
            for b in batches:
                fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                if len(fp):
                    row, key = _keys(fp, ball)
                    yield pa.record_batch([pa.array(key), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["key", "node", "fp"])

        return classes.select("node", "fp").mapInArrow(run, "key long, node long, fp long")

    own, near = keys(False), kept.table(keys(True), "ball-keys")
    # crowded keys are few by construction: each stands for more than CROWDED fingerprints
    size = near.groupBy("key").agg(F.count("*").alias("n"))
    size = kept.table(size.where("n > 1"), "buckets")
    few, many = size.where(F.col("n") <= CROWDED).select("key"), size.where(F.col("n") > CROWDED).select("key")
    left = own.join(few, "key").select("key", F.col("node").alias("a"), F.col("fp").alias("fa"))
    right = near.join(few, "key").select("key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    apart = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    pairs = left.join(right, "key").where((F.col("a") != F.col("b")) & (apart <= 2)).select("a", "b")
    dense = near.join(many, "key").select("node", "fp").distinct()

    def ball(batches):
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            points = (fp[:, None] ^ flips[None, :]).view(np.int64).ravel()
            yield pa.record_batch([pa.array(points), pa.array(np.repeat(b.column(0).to_numpy(), 65))], names=["point", "node"])

    points = dense.mapInArrow(ball, "point long, node long")
    hubs = points.groupBy("point").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("point", "hub")
    stars = points.join(hubs, "point").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate components: ``doc_id, fp, component_id``, one row per row of ``docs``.

    Documents whose fingerprints differ in two bits or fewer are linked; ``component_id`` is the smallest
    doc_id reachable. A text of fewer than ``words`` words is one shingle; a text with no word (or null)
    has fingerprint 0 and is linked like any other. A null ``doc_id`` counts as the smallest. Other columns
    are ignored.
    """
    found = materialise(fingerprints(docs, words, seed).withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))), "fingerprints")
    with Scratch(docs.sparkSession, "simhash") as kept:
        classes = kept.table(found.groupBy("fp").agg(F.min("doc").alias("node")), "fingerprint-classes")
        parts = components(links(classes, kept), classes.select("node"))
        member = materialise(classes.join(parts, "node").select("fp", F.col("component").alias("component_id")), "fingerprint-groups")
    return found.join(member, "fp").select("doc_id", "fp", F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"))


# --- similarity on shingles ----------------------------------------------------------------------------

#: Leaders of a bucket in the round after its smallest member; each further round takes eight times as many.
LEADERS = 128
#: Of a bucket of this many rows or fewer, all pairs meet at once.
FEW = 16
#: Parities kept of a set: a bound on how much two sets differ, without the sets.
PARITY = 512
#: Parities that a candidate pair is judged by before its sets are looked up.
WIDE = 8192
#: Counters of the table of frequent shingles; they set the order of shingles, never the result.
COUNTERS = 1 << 20
#: The most bits of a sieve of ids, 8 MB; a fuller sieve passes more rows to the exact join behind it.
SIEVE = 1 << 26
#: Texts that a task turns into sets at a time.
SLICE = 256


def shingle_codes(found: list[bytes], words: int, seed: int) -> np.ndarray:
    """A 64-bit code of every word shingle, repeats included, mixed from the XXH64 of its words. Fewer words are one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    code = np.fromiter((digest(w, seed) for w in found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(words, len(found))):
        mixed = (mixed ^ code[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def prefix_length(size: int, similarity: float) -> int:
    """How many of the first members of a set are keys: the sets of a similar pair share one of both their prefixes."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def frequent_shingles(docs: DataFrame, words: int, seed: int) -> np.ndarray:
    """A level for each counter of shingle codes: 0 for common ones, the more the more often its shingles stand out in a task.

    All texts are counted. Only counters well above a task's mean leave it, so at most a third of COUNTERS reach the driver.
    """

    def count(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for t in b.column(0):
                code = shingle_codes(words_of(t.as_py()), words, seed)
                np.add.at(seen, np.unique(code) & np.uint64(COUNTERS - 1), 1)
        at = np.nonzero(seen > 2 * seen.mean() + 4)[0]
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["counter", "n"])

    total = docs.where("text is not null").select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(COUNTERS, np.uint8)
    level[total.column("counter").to_numpy()] = np.log2(total.column("n").to_numpy())
    return level


def parities(codes: np.ndarray, n: int) -> np.ndarray:
    """How many codes fall on each of ``n`` places, as bits: odd or even."""
    odd = np.bincount((codes.view(np.uint64) >> np.uint64(32)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sieve(ids: DataFrame) -> np.ndarray:
    """Bits that pass every one of ``ids`` (one column of longs) and few others: three of sixteen or more an id, SIEVE at most.

    So rows that an exact join would leave out anyway need not be shuffled for it.
    """
    size = 1 << max(10, min((16 * ids.count()).bit_length(), SIEVE.bit_length() - 1))
    h, rest = F.xxhash64(ids.columns[0]), F.lit(size - 1)
    low, high = h.bitwiseAND(rest), F.shiftrightunsigned(h, 32).bitwiseAND(rest)
    at = ids.select(F.explode(F.array(*[(low + i * high).bitwiseAND(rest) for i in range(3)])).alias("at"))
    word = at.groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at & 7 as int)))").alias("bits")).toArrow()
    bits = np.zeros(size >> 3, np.uint8)
    bits[word.column("byte").to_numpy()] = word.column("bits").to_numpy()
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which ids a sieve passes, by their ``xxhash64``."""
    h, rest = hashes.view(np.uint64), np.uint64(8 * len(bits) - 1)
    at = [((h & rest) + np.uint64(i) * ((h >> np.uint64(32)) & rest)) & rest for i in range(3)]
    return np.logical_and.reduce([bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1 for x in at]).astype(bool)


def _ends(pairs: DataFrame, kept: Scratch) -> DataFrame:
    """Every ``node`` of the pairs, once."""
    return kept.table(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), "asked-nodes")


def _alike(pairs: DataFrame, sets, similarity: float, kept: Scratch) -> DataFrame:
    """The ``a, b`` pairs whose shingle sets have at least this Jaccard similarity.

    ``sets(nodes, wide)`` has ``node, size`` and ``wide`` or else ``shingles``. Two sets differ in at least as many members as in parities: a pair with
    more of those than its sizes allow members is out, and only the others move their sets.
    """
    wide = kept.table(sets(_ends(pairs, kept), True), "wide-parities")
    mark = lambda n: wide.select(F.col("node").alias(n), F.struct("size", "wide").alias("x" + n))
    x, y = F.col("xa"), F.col("xb")
    turned = F.aggregate(F.zip_with(x["wide"], y["wide"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    allowed = F.lit((1 - similarity) / (1 + similarity)) * (x["size"] + y["size"]) + F.lit(1e-6)
    asked = kept.table(pairs.join(mark("a"), "a").join(mark("b"), "b").where(turned <= allowed).select("a", "b").distinct(), "judged-pairs")
    kept.drop(wide)
    # texts that no judged pair asks for give no set
    used = kept.table(sets(_ends(asked, kept), False), "shingle-sets")
    one, other = used.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), used.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both / (F.size("sa") + F.size("sb") - both) >= F.lit(similarity)
    links = kept.table(asked.join(one, "a").join(other, "b").where(enough).select("a", "b").distinct(), "links")
    kept.drop(used)
    return links


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Groups of documents that share most of their word shingles: ``doc_id, component_id``, a row per row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``similarity``; ``component_id`` is the smallest doc_id reachable. No link is missed.

    Candidates come from two sides, and each is verified on the shingles. Golay keys of SimHash fingerprints of the same
    shingles (``links``) bring the closest copies together, in linear work even where thousands are alike. At 0.8 fingerprints
    differ by far more than two bits, so a prefix filter finds what is left: all sets are ordered alike, frequent
    shingles last; two sets of that similarity share a member of their first s - ceil(similarity * s) + 1, and each of
    these is a key. In buckets of at most FEW rows all pairs meet at once; the members of a larger one meet the smallest, and then leaders by rounds, 128 in the first and eight
    times as many in each further one; pairs that differ in too many parities are not looked up. A leader leaves after it
    has met all members of other groups; a bucket is done once its members are in one group. So a pair of one bucket is passed over only if other links join it already.

    Words are A-Z lower-cased. Texts with the same words are one class; fewer than ``words`` words match only
    the same words, a text with none (or null) all of its kind. A null ``doc_id`` counts as the smallest; rows that repeat a
    doc_id are one document. Very long texts are one row in one task, with 8 bytes a word. Other columns are ignored; an
    empty table gives none.
    """
    with Scratch(docs.sparkSession, "similar") as kept, small_batches(docs.sparkSession, SLICE):
        found = _similar(docs, words, similarity, seed, kept)
        return materialise(found, "similar-documents")


def _similar(docs: DataFrame, words: int, similarity: float, seed: int, kept: Scratch) -> DataFrame:
    import xxhash

    level = frequent_shingles(docs, words, seed)

    def ordered(code: np.ndarray) -> np.ndarray:
        """The distinct codes, frequent ones last: the one order of all sets."""
        code = np.unique(code)
        return code[np.argsort(level[code & np.uint64(COUNTERS - 1)], kind="stable")]

    def lists(columns: list[np.ndarray]) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, columns)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *columns])))

    def sliced(batches):
        return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))

    def classify(batches):
        for b in sliced(batches):
            same, fps, sizes, keys, parity = [], [], [], [], []
            for t in b.column(1):
                w = words_of(t.as_py())
                digest = xxhash.xxh3_128_intdigest(b" ".join(w), seed)
                same.append((digest >> 64, digest & (2**64 - 1)))
                code = shingle_codes(w, words, seed) if len(w) >= words else np.zeros(0, np.uint64)
                fps.append(_bits(sum(_ones(code[i : i + 65536]) for i in range(0, len(code), 65536)), len(code)) if len(code) else 0)
                x = ordered(code).view(np.int64)
                sizes.append(len(x))
                keys.append(x[: prefix_length(len(x), similarity)] if len(x) else x)
                parity.append(parities(x, PARITY))
            same = np.array(same, np.uint64).reshape(-1, 2).view(np.int64)
            fps = np.array(fps, np.uint64).view(np.int64)
            parity = np.array(parity, np.int64).reshape(-1, PARITY // 64)
            cells = [*map(pa.array, same.T.copy()), pa.array(fps), pa.array(sizes, pa.int32()), *map(pa.array, parity.T.copy()), lists(keys)]
            yield pa.record_batch([b.column(0), *cells], names=["doc", "s1", "s2", "fp", "size", *flags, "keys"])

    flags = [f"f{i}" for i in range(PARITY // 64)]

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    found = docs.select(doc.alias("doc"), "text").mapInArrow(classify, "doc long, s1 long, s2 long, fp long, size int, " + ", ".join(f"{f} long" for f in flags) + ", keys array<long>")
    found = kept.table(found, "prefixes")
    classes = kept.table(found.groupBy("s1", "s2").agg(F.min("doc").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size")), "word-classes")

    # close copies by Golay keys of fingerprints
    speaking = classes.where("size > 0")
    prints = kept.table(speaking.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    same_print = speaking.select("fp", "node").join(prints, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    close = kept.table(same_print.union(links(prints.select(F.col("head").alias("node"), "fp"), kept)), "close-pairs")

    # buckets of prefix keys; of a class, the rows of its smallest document speak; repeats among them make the same keys
    spoken = found.where("size > 0").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).where(F.col("doc") == F.col("node"))
    spoken = kept.table(spoken.select("node", "size", *flags, "keys"), "speaking-prefixes")
    rows = spoken.select("node", "size", F.posexplode("keys").alias("at", "key"))
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").distinct()
    shared, marks = kept.table(shared, "shared-keys"), kept.table(spoken.select("node", "size", *flags).distinct(), "parities")
    held = shared.where(F.col("n") > FEW).drop("n").join(marks, ["node", "size"])
    open_ = held.select("key", F.struct("node", "size", "at", *flags).alias("x"), F.col("node").alias("of"))
    open_, turn = kept.table(open_, "open-buckets"), 0
    kept.drop(spoken)
    group = classes.select("node", F.col("node").alias("component")).distinct()

    texts = docs.select(doc.alias("node"), F.xxhash64(doc).alias("hash"), "text").where(F.col("text").isNotNull())
    repeats = not found.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def sets(nodes: DataFrame, wide: bool) -> DataFrame:
        """The parities or the sets of some nodes, read where the texts lie; rows that repeat a doc_id speak for one node, each with its own."""
        bits, kind = sieve(nodes), "wide" if wide else "shingles"

        def shingle(batches):
            for b in sliced(batches):
                b = b.filter(pa.array(passes(bits, b.column(1).to_numpy())))
                codes = [np.unique(shingle_codes(words_of(t.as_py()), words, seed)).view(np.int64) for t in b.column(2)]
                if codes:
                    yield pa.record_batch([b.column(0), pa.array([len(c) for c in codes], pa.int32()), lists([parities(c, WIDE) for c in codes] if wide else codes)], names=["node", "size", kind])

        new = texts.mapInArrow(shingle, f"node long, size int, {kind} array<long>")
        if repeats:
            new = new.join(nodes, "node", "left_semi").withColumn("same", F.xxhash64(kind)).dropDuplicates(["node", "size", "same"]).drop("same")
        return new

    def room(x, y):
        """Whether two rows of one key can be similar by what lies before, at and after the key."""
        most = F.least(x["at"], y["at"]) + F.least(x["size"] - x["at"], y["size"] - y["at"])
        return (x["node"] != y["node"]) & (most >= F.lit(similarity / (1 + similarity)) * (x["size"] + y["size"]) - F.lit(1e-6))

    def even(x, y):
        """Whether two sets can be similar by parities.

        Sets of that similarity differ in at most (1 - s) / (1 + s) of their sizes' sum; every member that only one of
        them has turns one parity.
        """
        turned = reduce(lambda a, b: a + b, [F.bit_count(x[f].bitwiseXOR(y[f])) for f in flags])
        return turned <= F.lit((1 - similarity) / (1 + similarity)) * (x["size"] + y["size"]) + F.lit(1e-6)

    # of buckets of a few rows, all pairs: each once, however many keys it shares, and only then with its parities
    few = shared.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list(F.struct("node", "size", "at")).alias("xs"))
    few = few.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y")).where((F.col("x.node") < F.col("y.node")) & room(F.col("x"), F.col("y")))
    few = few.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    mark = lambda n: marks.select(F.col("node").alias(n), F.struct("size", *flags).alias("x" + n))
    few = few.join(mark("a"), "a").join(mark("b"), "b").where(even(F.col("xa"), F.col("xb"))).select("a", "b")
    close = kept.table(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(few).distinct(), "pairs-of-few")

    while not turn or not open_.isEmpty():
        if turn == 0:
            leaders = open_.groupBy("key").agg(F.min(F.struct("x", "of")).alias("l"))
        else:
            # by turns from all members and from all groups, the same nodes in many buckets
            slot = F.pmod(F.xxhash64(F.col("x.node") if turn % 2 else F.col("of"), F.lit(turn)), F.lit(LEADERS << (3 * turn - 3)))
            leaders = open_.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("x.node", F.lit(turn)).alias("h"), "x", "of")).alias("l"))
        leaders = kept.table(leaders.select("key", "l.x", "l.of"), "leaders")
        others = leaders.select(F.col("key").alias("k"), F.col("x").alias("y"), F.col("of").alias("y_of"))
        met = open_.join(others, (F.col("key") == F.col("k")) & (F.col("of") != F.col("y_of")) & room(F.col("x"), F.col("y")) & even(F.col("x"), F.col("y")))
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs = kept.table((pairs if turn else pairs.union(close)).distinct(), "pairs")
        found_any = not pairs.isEmpty()
        if found_any:
            new = _alike(pairs, sets, similarity, kept)
        rest = open_.withColumn("led", F.col("x.node")).join(leaders.select("key", F.col("x.node").alias("led")), ["key", "led"], "left_anti")
        if found_any and not new.isEmpty():
            for end in "ab":
                new = new.join(group.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end)
            joined = kept.table(_components(new.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), kept), "joined-groups")
            group = group.join(joined.select(F.col("u").alias("component"), F.col("component").alias("to")), "component", "left")
            group = kept.table(group.select("node", F.coalesce("to", "component").alias("component")), "groups")
        # what is left of buckets with members of two groups or more
        of = group.select(F.col("node").alias("led"), F.col("component").alias("of"))
        rest = rest.drop("of").join(of, "led").select("key", "x", "of")
        mixed = rest.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("key")
        before, open_, turn = open_, kept.table(rest.join(mixed, "key"), "open-buckets"), turn + 1
        for done in (before, leaders, pairs):
            kept.drop(done)
    member = found.select("doc", "s1", "s2").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).join(group, "node")
    least = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return member.select(least("doc").alias("doc_id"), least("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one document, the smallest ``doc_id``, of each group of similar documents; all columns stay.

    Of rows that repeat a kept doc_id, one stays. Only texts of ids to drop, or repeated, and the few more that their sieve passes are shuffled.
    """
    first = F.sum(F.col("doc_id").eqNullSafe(F.col("component_id")).cast("long"))
    odd = similar_documents(docs, words, similarity).groupBy(F.col("doc_id").alias("odd_id")).agg(first.alias("alike")).where("alike <> 1")
    odd = materialise(odd, "dropped-ids")
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))
    bits = sieve(odd.select(key("odd_id").alias("id")))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(passes(bits, h.to_numpy()))

    asked = maybe(F.xxhash64(key("doc_id")))
    same = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    kept = docs.where(~asked).union(docs.where(asked).join(odd, same, "left_anti"))
    again = odd.where("alike > 1")
    if again.isEmpty():
        return kept
    # rows that repeat an id are one document
    return kept.union(docs.where(asked).join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; texts without words, null ids and repeated rows as ``near_duplicates`` defines them."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
