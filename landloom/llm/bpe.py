"""BPE encoding and decoding with a public vocabulary by tree concatenation, exact on texts of any length.

A text is halved, at whatever character lies in the middle, until every piece is a leaf of at most ``leaf``
characters. Leaves are rows of their own; each is encoded in parallel as one string, as if the text began and ended with it. Then
halves are joined in pairs, level by level. Around each join a window, the last id of the left half and the first of the right one at first, is
encoded anew from the text under it. It is twice as wide each time until its first id is the left half's own at the same place and its last id the
right half's: what lies further out then stays as it was. A window that has reached white space needs no more, as this
vocabulary drops white space and never merges across it. So a piece carries the text at its ends up to white space, and ids alone between.

A run without white space that is longer than a leaf gives no such place: its words (as the tokenizer's own normaliser and pre-tokeniser cut
them) are halved down to leaves, too, and at a join a window of ids is decoded and encoded anew, and grows until it
begins with the left half's own id and ends with the right half's own id: neighbouring ids that BPE itself produced on both
sides then stay valid.

For texts of one leaf a task remembers the ids of chunks, so only new ones go through the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Texts of more characters than this are split into leaves of at most this many.
LEAF = 4096
#: Chunks that a Python worker remembers before it starts its table anew, some 150 MB.
REMEMBERED = 800_000
#: Characters of text, about, that a piece keeps at either end for windows; more, up to the next white space.
EDGE = 64
BLANK = re.compile(r"[\x20\x09-\x0D]")


class Spelling:
    """Strings by id, to be joined by single blanks, as one table of UTF-8 bytes."""

    def __init__(self, strings: list[str]):
        parts = [b" " + s.encode("utf-8", "surrogatepass") for s in strings]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.cumsum([0, *map(len, parts)])

    def of(self, ids: np.ndarray, block: int = 1 << 16) -> bytes:
        out = []
        for at in range(0, len(ids), block):
            i = ids[at : at + block].astype(np.int64)
            sizes = self.starts[i + 1] - self.starts[i]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.starts[i] - ends + sizes, sizes)].tobytes())
        return b"".join(out)[1:]


class Codec:
    """The tokenizer file and what tree concatenation needs of it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        spec = json.loads(self.whole.to_str())
        self.model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = {t: self.whole.token_to_id(t) for t in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        size = 1 + max(self.token)
        self.numbers, self.spellings = (Spelling(x) for x in ([str(i) for i in range(size)], [self.token.get(i, "") for i in range(size)]))
        self.known: dict[bytes, bytes] = {}
        self.windows: Counter[int] = Counter()  # how wide the windows of joins were in the end

    def _parts(self, suffix: str):
        """The model alone, for parts of words; only texts with very long chunks need it."""
        from tokenizers import Tokenizer, models

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in self.model["merges"]]
        return Tokenizer(models.BPE(self.model["vocab"], merges, **({"end_of_word_suffix": suffix} if suffix else {})))

    @cached_property
    def inner(self):
        return self._parts("")

    @cached_property
    def last(self):
        return self._parts(self.suffix)

    def chunks(self, texts: list[list[bytes]]) -> None:
        """Make the packed ids of every chunk (in UTF-8) of the lists known."""
        every = set().union(*texts)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(every)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for c, e in zip(part, self.whole.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                self.known[c] = self.packed(e.ids)

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a file without a decoder."""
        token = self.token
        return " ".join([token[i] for i in ids])

    def words(self, chunk: str) -> list[tuple[str, int | None]]:
        """The words of a chunk as the model sees them; a special token comes with its id."""
        found: list[tuple[str, int | None]] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                found.append((part, self.special[part]))
            elif part:
                text = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                found += [(w, None) for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return found

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def crossing(self, a: str, b: str) -> tuple[int, int]:
        """How far a special token that lies across the border of ``a`` and ``b`` reaches into either."""
        most = max(map(len, self.special), default=1) - 1
        left, right = a[len(a) - most :] if len(a) > most else a, b[:most]
        for m in self.cut.finditer(left + right) if self.cut else ():
            if m.start() < len(left) < m.end():
                return len(left) - m.start(), m.end() - len(left)
        return 0, 0

    def encode_part(self, part: str, last: bool) -> list[int]:
        return (self.last if last else self.inner).encode(part, add_special_tokens=False).ids

    def spelled(self, ids: list[int]) -> str:
        return "".join(self.token[i] for i in ids)

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The ids of a word (its end, if ``last``) from those of its two halves."""
        n = 4
        while True:
            a, b = left[-n:], right[:n]
            at_end = last and len(b) == len(right)
            text = self.spelled(a) + self.spelled(b)
            if at_end:
                text = text.removesuffix(self.suffix)
            new = self.encode_part(text, at_end)
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            n *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Join the leaves of one word in pairs, level by level."""
        while len(parts) > 1:
            ends = len(parts) - len(parts) % 2
            joined = [self.join(parts[i], parts[i + 1], i + 2 == len(parts)) for i in range(0, ends, 2)]
            parts = joined + parts[ends:]
        return parts[0] if parts else []


@dataclass
class Cell:
    """Ids of a stretch of text; with the text and the places of the ids in it at the ends of a piece, without in its middle."""

    ids: np.ndarray
    text: str | None = None
    spans: np.ndarray | None = None

    def part(self, lo: int, hi: int) -> Cell:
        """The stretch between two places that no id lies across."""
        at = (self.spans[:, 0] >= lo) & (self.spans[:, 1] <= hi)
        return Cell(self.ids[at], self.text[lo:hi], self.spans[at] - lo)


def coded(c: Codec, texts: list[str]) -> list[Cell]:
    """Texts encoded whole, each by itself."""
    found = []
    for t, e in zip(texts, c.whole.encode_batch(texts, add_special_tokens=False), strict=True):
        found.append(Cell(np.array(e.ids, c.kind), t, np.array(e.offsets, np.int32).reshape(-1, 2)))
    return found


def leaf_pieces(c: Codec, texts: list[str]) -> list[list[Cell]]:
    """Every leaf as a sealed piece. The whole leaf gives the ids; where they lie is asked for its ends alone, up to white space."""
    whole = [np.array(e.ids, c.kind) for e in c.whole.encode_batch_fast(texts, add_special_tokens=False)]
    cuts, ends = [], []
    for t in texts:
        left, back = BLANK.search(t, EDGE), BLANK.search(t[::-1], EDGE)
        cuts.append((left.start(), len(t) - back.start()) if left and back and left.start() < len(t) - back.start() else None)
        ends += [t[: cuts[-1][0]], t[cuts[-1][1] :]] if cuts[-1] else [t]
    found, at = [], iter(coded(c, ends))
    for ids, cut in zip(whole, cuts, strict=True):
        first = next(at)
        if cut is None:
            found.append([first])
            continue
        last = next(at)
        found.append([first, Cell(ids[len(first.ids) : len(ids) - len(last.ids)]), last])
    return found


def sealed(cells: list[Cell]) -> list[Cell]:
    """A piece with text at its ends only: up to the first white space that EDGE characters lie before."""
    first, last = cells[0], cells[-1]
    left = BLANK.search(first.text, EDGE)
    if len(cells) == 1:
        back = BLANK.search(first.text[::-1], EDGE)
        if not left or not back or left.start() >= len(first.text) - back.start():
            return cells
        lo, hi = left.start(), len(first.text) - back.start()
        return [first.part(0, lo), Cell(first.part(lo, hi).ids), first.part(hi, len(first.text))]
    middle = [x.ids for x in cells[1:-1]]
    if left:
        middle.insert(0, first.part(left.start(), len(first.text)).ids)
        first = first.part(0, left.start())
    back = BLANK.search(last.text[::-1], EDGE)
    if back:
        at = len(last.text) - back.start()
        middle.append(last.part(0, at).ids)
        last = last.part(at, len(last.text))
    return [first, Cell(np.concatenate(middle)), last] if middle else [first, last]


def join_pieces(c: Codec, a: list[Cell], b: list[Cell]) -> list[Cell]:
    """Two neighbouring pieces: a window around their border grows until both sides agree."""
    x, y, size = a[-1], b[0], 1
    over = c.crossing(x.text, y.text)
    while True:
        i, j = max(len(x.ids) - size, 0), min(size, len(y.ids))
        start = int(x.spans[i, 0]) if i else 0
        end = int(y.spans[j - 1, 1]) if j < len(y.ids) else len(y.text)
        (new,) = coded(c, [x.text[start:] + y.text[:end]])
        new.spans += start
        shift = len(x.text)
        agrees = lambda k, n, ids, spans, d: len(new.ids) and new.ids[n] == ids[k] and (new.spans[n] == spans[k] + d).all()
        left = not i or shift - start >= over[0] and agrees(i, 0, x.ids, x.spans, 0)
        right = j == len(y.ids) or end >= over[1] and agrees(j - 1, -1, y.ids, y.spans, shift)
        if left and right:
            c.windows[size] += 1
            whole = Cell(np.concatenate([x.ids[:i], new.ids, y.ids[j:]]), x.text + y.text, np.concatenate([x.spans[:i], new.spans, y.spans[j:] + shift]))
            return sealed([*a[:-1], whole, *b[1:]])
        size *= 2


def join_all(c: Codec, pieces: list[list[Cell]]) -> np.ndarray:
    """The ids of a text from its leaves, joined in pairs, level by level."""
    while len(pieces) > 1:
        joined = [join_pieces(c, pieces[i], pieces[i + 1]) for i in range(0, len(pieces) - 1, 2)]
        pieces = joined + pieces[len(pieces) - len(pieces) % 2 :]
    return np.concatenate([x.ids for x in pieces[0]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(word: str, leaf: int) -> list[str]:
    if len(word) <= leaf:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], leaf) + halves(word[mid:], leaf)


#: Where a leaf belongs: its text (by place), the document, the run or word of the text, its number there, and what it is.
AT = "row long, doc_id long, seq long, leaf long, kind long"
PLACE = [f.split()[0] for f in AT.split(", ")]


def _is_long(leaf: int) -> Column:
    return F.coalesce(F.char_length("text") > leaf, F.lit(False))


def long_leaves(docs: DataFrame, vocabulary: str, leaf: int = LEAF) -> DataFrame:
    """The leaves of all texts longer than ``leaf``, and leaves of the words of chunks longer than that: ``PLACE`` and ``text``.

    Kind 0 is a part of a run of chunks, 1 a part of a word, 2 the end of a word, 3 a special token.
    """
    long_chunk = re.compile(r"[^\x20\x09-\x0D]{%d,}" % (leaf + 1))

    def leaves(batches):
        """The leaves of long texts, and leaves of the words of their long chunks."""
        c = codec(vocabulary)
        for b in batches:
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                out, seq, at = [], 0, 0
                for m in [*long_chunk.finditer(text), None]:
                    cut = halves(text[at : m.start() if m else len(text)], leaf)
                    out += [(row, doc, seq, k, 0, p) for k, p in enumerate(cut)]
                    seq += 1
                    if m is None:
                        break
                    at = m.end()
                    for word, special in c.words(m[0]):
                        if special is not None:
                            out.append((row, doc, seq, 0, 3, word))
                        else:
                            cut = halves(word, leaf)
                            out += [(row, doc, seq, k, 2 if k + 1 == len(cut) else 1, p) for k, p in enumerate(cut)]
                        seq += 1
                yield pa.record_batch(list(map(pa.array, zip(*out))), names=[*PLACE, "text"])

    long_ = docs.where(_is_long(leaf)).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return long_.mapInArrow(leaves, AT + ", text string")


def encode(docs: DataFrame, vocabulary: str, leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns, for each row of ``docs``, ``doc_id, n_tokens, ids`` (decimal ids joined by one space) and
    ``decoded``; with ``with_ids`` off, their SHA-256 in hex as ``ids_sha256, decoded_sha256`` instead. Ids are
    those of the tokenizers library's ``encode(text, add_special_tokens=False)`` with the file ``vocabulary``,
    which must drop white space and have no decoder; strings of special tokens inside a text become
    their ids. A null or empty text has no ids. Rows that repeat are encoded each; a null ``doc_id`` stays.
    Texts longer than ``leaf`` go through the tree; one document's pieces meet in one task, as its row does. A text
    without words has no ids. Texts are told apart by their place in ``docs``, so that has to give its rows in the same order when a
    lost executor's part is read again, as a table does. Other columns are ignored; an empty table gives none. The file must be readable under that
    path on every executor.
    """
    cells = "n_tokens long, " + ("ids string, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string")
    names = ["n_tokens", *(["ids", "decoded"] if with_ids else ["ids_sha256", "decoded_sha256"])]

    def shown(c: Codec, ids: np.ndarray) -> tuple[int, str, str]:
        both = c.numbers.of(ids), c.spellings.of(ids)
        return len(ids), *(x.decode("utf-8", "surrogatepass") if with_ids else hashlib.sha256(x).hexdigest() for x in both)

    def short(batches):
        c = codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                # bytes split at the six ASCII white-space characters and nowhere else
                cut = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                c.chunks(cut)
                ids = c.known.__getitem__
                out = [shown(c, np.frombuffer(b"".join(map(ids, chunks)), c.kind)) for chunks in cut]
                yield pa.record_batch([part.column(0), *map(pa.array, zip(*out))], names=["doc_id", *names])

    def pieces(batches):
        c = codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                kinds, texts = part.column("kind").to_pylist(), part.column("text").to_pylist()
                runs = iter(leaf_pieces(c, [t for k, t in zip(kinds, texts) if k == 0]))
                found: list[list[Cell]] = []
                for kind, text in zip(kinds, texts):
                    if kind == 0:
                        found.append(next(runs))
                    else:
                        found.append([Cell(np.array([c.special[text]] if kind == 3 else c.encode_part(text, kind == 2), c.kind))])
                cells = [
                    pa.array([[x.text for x in p] for p in found], pa.list_(pa.string())), pa.array([[x.ids.tobytes() for x in p] for p in found], pa.list_(pa.binary())),
                    pa.array([[None if x.spans is None else x.spans.tobytes() for x in p] for p in found], pa.list_(pa.binary())),
                ]
                yield pa.record_batch([*(part.column(i) for i in PLACE), *cells], names=[*PLACE, "texts", "ids", "spans"])

    def unpacked(c: Codec, texts: list, ids: list, spans: list) -> list[Cell]:
        return [Cell(np.frombuffer(i, c.kind), t, None if s is None else np.frombuffer(s, np.int32).reshape(-1, 2)) for t, i, s in zip(texts, ids, spans)]

    def finished(c: Codec, doc: int | None, parts: list) -> tuple:
        """One document from its pieces, in order."""
        found = []
        for _, unit in groupby(parts, key=lambda p: p[0]):
            unit = list(unit)
            if unit[0][1] == 0:
                found.append(join_all(c, [u[2] for u in unit]))
            else:
                found.append(np.array(c.tree([u[2][0].ids.tolist() for u in unit]), c.kind))
        return doc, *shown(c, np.concatenate(found))

    def assemble(batches):
        """Pieces of one document after another, sorted, to one row each."""
        c, current, doc, parts, out = codec(vocabulary), None, None, [], []
        table = lambda: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["doc_id", *names])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row, doc_id, seq, _, kind, *piece in zip(*(x.to_pylist() for x in b.slice(at, 256).columns)):
                    if row != current:
                        if parts:
                            out.append(finished(c, doc, parts))
                        current, doc, parts = row, doc_id, []
                    parts.append((seq, kind, unpacked(c, *piece)))
                if len(out) >= 64:
                    yield table()
                    out = []
        if parts:
            out.append(finished(c, doc, parts))
        if out:
            yield table()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    quick = docs.where(~_is_long(leaf)).mapInArrow(short, "doc_id long, " + cells)
    cut = long_leaves(docs, vocabulary, leaf).repartition("row", "seq", "leaf")
    found = cut.mapInArrow(pieces, AT + ", texts array<string>, ids array<binary>, spans array<binary>")
    found = found.repartition("row").sortWithinPartitions("row", "seq", "leaf")
    return quick.union(found.mapInArrow(assemble, "doc_id long, " + cells))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all ``documents`` as digests; rows as ``encode`` defines them."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
