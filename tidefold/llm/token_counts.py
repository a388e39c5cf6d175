"""Token counts of whole texts, however long, by pieces that are joined where they agree.

A text of more than one piece is cut at any character; each piece also reads
some way into the next one. Both are encoded with offsets. A byte-level
tokenizer finds its words by one scan from left to right that never looks
back, so from a place where a word starts in the whole text, the scan of any
piece that has a word start there goes on like the scan of the whole text.
Of a piece, what lies further than `margin` from its end does not depend on
what follows. So a word start that both pieces have, outside that margin, is
a proven place to go over from one to the other. Two pieces without such a
place, as within a word longer than the overlap, are encoded again with a
wider one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, frugal, stored, text_slices


@dataclass(frozen=True)
class Shape:
    stride: int = 1 << 15  # bytes from the start of a piece to that of the next; shorter texts are encoded whole
    overlap: int = 512  # bytes that a piece reads of the next one, at first
    widening: int = 8  # by this the overlap grows where two pieces do not meet
    batch: int = 1 << 21  # bytes of short texts whose units are told apart together


@dataclass(frozen=True)
class Definition:
    """A tokenizer file's content, and how near to a piece's end its words may depend on what follows."""

    text: str
    margin: int


def load(path: str | None = None) -> Definition:
    """The tokenizer of a .json file (the library's byte-level BPE of 50,257 ids if none is named).

    ValueError for kinds whose words are not found by a scan from left to
    right without a look back, as the places where pieces meet are proven for
    those only. Truncation, padding and what adds special tokens are left out.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    words = d.get("pre_tokenizer") or {}
    added = d.get("added_tokens") or []
    odd = [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if d.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or odd:
        raise ValueError("only byte-level tokenizers without a normalizer can be counted by pieces")
    d |= {"truncation": None, "padding": None, "post_processor": None}
    # a contraction has three characters; a cut special token changes the words up to one before it
    return Definition(json.dumps(d), max([0, *(len(t["content"].encode()) for t in added)]) + 16)


def _tokenizer(definition: Definition):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition.text)


#: A space at the start or the end of a text, or beside white space of any kind: such a text is encoded whole.
ODD_SPACE = r"^ | $|[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]"


class Units:
    """Token counts of texts from those of their units, of which each different one is encoded once.

    Between two characters that are no white space, a space starts a word of
    the tokenizer, and the word before it ends there. So the tokens of a text
    of only such spaces are those of its units, each with the space before
    it. Other texts are encoded whole. `most` units are remembered; what is
    forgotten is encoded again.
    """

    def __init__(self, definition: Definition, most: int = 600_000) -> None:
        self.tokenizer, self.most, self.known = _tokenizer(definition), most, {}
        self.apart = not any(" " in t["content"] for t in json.loads(definition.text).get("added_tokens") or [])

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for i in range(0, len(texts), 2000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        given = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(given, ODD_SPACE).to_numpy(zero_copy_only=False) | (not self.apart)
        counts = np.zeros(len(texts), np.int64)
        counts[whole] = self.encoded([texts[i] for i in np.flatnonzero(whole).tolist()])
        split = pc.split_pattern(given.filter(pa.array(~whole)), " ")
        ends = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy().astype(np.int64)))
        first = np.zeros(ends[-1], bool)
        first[ends[:-1]] = True  # has no space before it
        units = split.flatten()
        coded = pc.if_else(pa.array(first), units, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), units, pa.scalar(" ", pa.large_string()))).dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [u for u in names if u not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, names
        self.known.update(dict(zip(new, self.encoded(new), strict=True)))
        n = np.array([self.known[u] for u in names], np.int64)
        counts[~whole] = np.diff(np.append(0, np.cumsum(n[coded.indices.to_numpy()]))[ends])
        return counts


_UNITS: dict[str, Units] = {}


def units_of(definition: Definition) -> Units:
    """The counter of a worker, which outlives its tasks."""
    if definition.text not in _UNITS:
        _UNITS.clear()
        _UNITS[definition.text] = Units(definition)
    return _UNITS[definition.text]


def cuts(data: np.ndarray, stride: int) -> list[int]:
    """Where the pieces of a UTF-8 text start: multiples of `stride`, moved back to the start of a character."""
    found = list(range(0, len(data), stride))
    for i, at in enumerate(found):
        while at and data[at] & 0xC0 == 0x80:
            at -= 1
        found[i] = at
    return found


def word_starts(tokenizer, piece: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte offsets of the words in a piece, the number of tokens before each, and the number of all."""
    e = tokenizer.encode(piece.decode(), add_special_tokens=False)
    if not len(e):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    words = np.array(e.word_ids, np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    offsets = e.offsets
    char = np.array([offsets[i][0] for i in first.tolist()], np.int64)
    starts = np.flatnonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80)
    return starts[char], first, len(words)


def _cut(texts: DataFrame, stride: int, overlap: int) -> DataFrame:
    """(digest, number, at, next, piece): the pieces of each different text once; `next` is where the following piece starts, null for the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for b in batches:
            for digest, text in zip(b.column(0), b.column(1), strict=True):
                raw = text.cast(pa.binary()).as_buffer()
                data = np.frombuffer(raw, np.uint8)
                at = cuts(data, stride)
                if len(at) > 1 and len(data) - at[-1] <= overlap:
                    at.pop()  # the piece before reads it to the end
                ends = []
                for x in at[1:]:
                    end = min(x + overlap, len(data))
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    ends.append(end)
                rows = list(zip(at, [*at[1:], None], [*ends, len(data)], strict=True))
                for k in range(0, len(rows), 64):
                    part = rows[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * len(part)), pa.array(range(k, k + len(part)), pa.int32()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([data[a:e].tobytes() for a, _, e in part], pa.binary())], ["digest", "number", "at", "next", "piece"])

    made = texts.mapInArrow(run, "digest string, number int, at long, next long, piece binary")
    return made.dropDuplicates(["digest", "number"])  # copies are combined before the shuffle, which spreads the pieces of a text


def _spliced(pieces: DataFrame, shared, overlap: int) -> DataFrame:
    """(digest, n_tokens, met): the tokens of each text, and whether all neighbouring pieces met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        definition = shared.value
        tokenizer = _tokenizer(definition)
        for b in batches:
            out = {k: [] for k in ("digest", "junction", "head", "head_n", "tail", "tail_n", "total")}

            def add(**row):
                for k, v in out.items():
                    v.append(row.get(k))

            for digest, number, at, following, piece in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                where, before, total = word_starts(tokenizer, piece)
                where = where + at
                if number:
                    own = where <= at + overlap
                    add(digest=digest, junction=number, head=where[own].tolist(), head_n=before[own].tolist())
                if following is None:
                    add(digest=digest, junction=number + 1, total=total)
                else:
                    own = (where >= following) & (where <= at + len(piece) - definition.margin)
                    add(digest=digest, junction=number + 1, tail=where[own].tolist(), tail_n=before[own].tolist())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int32(), longs, longs, longs, longs, pa.int64()), strict=True)], list(out))

    sides = pieces.select("digest", "number", "at", "next", "piece").mapInArrow(run, "digest string, junction int, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>, total long")
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    met = sides.groupBy("digest", "junction").agg(*[one(c) for c in ("head", "head_n", "tail", "tail_n", "total")])
    met = met.withColumn("place", F.try_element_at(F.array_intersect("tail", "head"), F.lit(1)))
    count = lambda at, n: F.element_at(n, F.array_position(at, F.col("place")).cast("int"))
    gain = F.when(F.col("total").isNotNull(), F.col("total")).when(F.col("place").isNotNull(), count("tail", "tail_n") - count("head", "head_n"))
    return met.select("digest", gain.alias("gain")).groupBy("digest").agg(F.sum("gain").alias("n_tokens"), F.bool_and(F.col("gain").isNotNull()).alias("met"))


def token_counts(docs: DataFrame, keep: list[str], definition: Definition, shape: Shape = Shape()) -> DataFrame:
    """The columns `keep` of every row, n_bytes (UTF-8) and n_tokens, the length of the library's encoding of the whole text.

    No begin, end or added special tokens; strings of special tokens inside a
    text are encoded as these. Null texts count as empty (0, 0). Bytes that
    are no UTF-8 are encoded as U+FFFD. Repeated rows are rows of their own;
    of equal long texts one is encoded. An empty table gives no rows. Columns
    of `keep` named like a result give way to it; other names clash with
    nothing.

    Texts up to a stride are encoded where they are read, without a shuffle,
    and of their units between single spaces each different one once.
    The pieces of longer ones are spread over the tasks, so a text of any
    length is encoded by many tasks and in bounded memory. Only a text with
    a word longer than a stride is encoded in pieces as large as that needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # its size is the vocabulary's
    kept = Kept(keep, "n_bytes", "n_tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*kept.columns(), F.octet_length(text).cast("long").alias("_bytes"), F.make_valid_utf8(text).alias("_text"))
    size = F.octet_length("_text")
    passed = [*kept.inner, "_bytes"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        count = units_of(shared.value)
        for b in batches:
            n = [count(texts) for texts in text_slices(b.column("_text"), shape.batch)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in passed], pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], [*passed, "n_tokens"])

    short = rows.where(size <= shape.stride).mapInArrow(whole, rows.select(*passed).schema.add("n_tokens", "long"))
    long = rows.where(size > shape.stride).withColumn("digest", F.sha2("_text", 256))
    todo, stride, overlap, counts = long, shape.stride, shape.overlap, None
    while True:
        found = stored(_spliced(_cut(todo.select("digest", "_text"), stride, overlap), shared, overlap), "token-counts")
        good = found.where("met").select("digest", "n_tokens")
        counts = good if counts is None else counts.unionByName(good)
        failed = found.where("NOT met").select("digest")
        if failed.isEmpty():
            break
        overlap *= shape.widening
        stride = max(stride, 4 * overlap)  # in the end one piece holds the text
        todo = long.join(failed, "digest", "left_semi")
    pieced = long.select(*passed, "digest").join(counts, "digest").select(*passed, "n_tokens")
    return kept.restored(short.unionByName(pieced), F.col("_bytes").alias("n_bytes"), "n_tokens")
