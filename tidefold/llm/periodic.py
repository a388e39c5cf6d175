"""Periodic runs of words: stretches that repeat a few words over and over, as broken generators and boilerplate do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, array_slices, frugal


@dataclass(frozen=True)
class Shape:
    times: int = 4  # a run is at least so many periods long, 3 or more
    least: int = 6  # and so many words
    settled: float = 0.01  # a segment that loses a smaller share of its words than this is not counted again


def surviving(words: np.ndarray, doc: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(positions, segment of each): what is left when words too rare within their segment split it, again and again.

    Each word of a run occurs `times` times in it, so a word that is rarer in
    its segment is in no run, and runs lie within what it separates. Segments
    that lose words are counted again until they lose none (or so few that
    going on costs more than the scan of what is left).
    """
    at, segment, done = np.arange(len(words)), doc.astype(np.int64), []
    span = int(words.max(initial=0)) + 1
    while len(at):
        _, name, count = np.unique(segment * span + words[at], return_inverse=True, return_counts=True)
        good = count[name] >= shape.times
        size = np.bincount(segment)
        lost = size - np.bincount(segment, weights=good, minlength=len(size)).astype(np.int64)
        again = (lost > shape.settled * size)[segment[good]]
        at, segment = at[good], segment[good]
        segment = np.cumsum(np.r_[True, (np.diff(at) != 1) | (np.diff(segment) != 0)][: len(at)]) - 1
        large = np.bincount(segment)[segment] >= shape.least if len(at) else np.empty(0, bool)
        done.append(at[large & ~again])
        at, segment = at[large & again], segment[large & again]
        segment = np.unique(segment, return_inverse=True)[1]
    at = np.sort(np.concatenate(done)) if done else np.empty(0, np.int64)
    return at, np.cumsum(np.r_[True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0)][: len(at)]) - 1


def find_runs(words: np.ndarray, doc: np.ndarray, shape: Shape = Shape()) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; words are ids, doc is the (rising) number of each word's text.

    Lags are scanned by powers of two: for periods over L/2 up to L, the groups
    of L words are named by joining two names of half the length, and the lag
    to the next equal group is looked at. Within a run of smallest period q,
    groups of q words or more recur after q words and never sooner, so the
    successive places with the same lag are the run. All texts are scanned
    together, n log n in all.
    """
    if shape.times < 3:
        raise ValueError("a run has at least 3 periods")
    at, segment = surviving(words, doc, shape)
    found, length = [], 1
    here = np.arange(len(at))
    end = np.searchsorted(segment, segment, "right")  # of each place's segment
    begin = np.searchsorted(segment, segment, "left")
    name = np.unique(segment * (int(words.max(initial=0)) + 1) + words[at], return_inverse=True)[1] if len(at) else np.empty(0, np.int64)
    while len(here):
        order = np.argsort(name[here], kind="stable")
        same = np.diff(name[here][order]) == 0
        lag = np.zeros(len(here), np.int64)
        lag[order[:-1][same]] = np.diff(here[order])[same]
        hit = (lag > length // 2) & (lag <= length)
        i, q = here[hit], lag[hit]
        if len(i):
            head = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(q) != 0)])
            last = np.r_[head[1:], len(i)] - 1
            size, period = i[last] - i[head] + q[head] + length, q[head]
            good = size >= np.maximum(shape.least, shape.times * period)
            found.append(np.stack([at[i[head]], size, period], 1)[good])
        # groups that do not recur are in no run, and longer periods need longer segments
        more = np.zeros(len(here), bool)
        more[order[:-1][same]] = True
        more[order[1:][same]] = True
        more &= (end - begin)[here] >= shape.times * (length + 1)
        known = np.zeros(len(at) + length, bool)
        known[here[more]] = True
        here = here[more]
        here = here[(here + 2 * length <= end[here]) & known[here + length]]
        joined = np.unique(name[here] * len(at) + name[np.minimum(here + length, len(at) - 1)], return_inverse=True)[1] if len(here) else name[:0]
        name = np.zeros(len(at), np.int64)
        name[here] = joined
        length *= 2
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


RUNS_TYPE = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs_of(texts: pa.Array, shape: Shape) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(words, runs, collapsed) of each text of a slice."""
    # splits at space and the control characters 9 to 13 alone, with empty words at the ends
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(parts)
    doc = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, doc = flat.filter(pa.array(real)), doc[real]
    sizes = np.bincount(doc, minlength=len(texts))
    begins = np.cumsum(np.r_[0, sizes])
    found = find_runs(flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, shape)
    edge = np.zeros(len(flat) + 1, np.int64)  # +1 where what a run repeats begins, -1 where it ends
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    ends = np.cumsum(np.r_[0, np.bincount(doc[kept], minlength=len(texts))])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(kept))), " ")
    owner = doc[found[:, 0]]
    edges = np.cumsum(np.r_[0, np.bincount(owner, minlength=len(texts))])
    fields = [pa.array(found[:, 0] - begins[owner]), pa.array(found[:, 1]), pa.array(found[:, 2])]
    runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUNS.value_type)))
    return pa.array(sizes, pa.int64()), runs, collapsed


def periodic_runs(docs: DataFrame, keep: list[str], shape: Shape = Shape()) -> DataFrame:
    """The columns `keep` of every row, n_words, runs (array of start, length, period, in words from 0, by start and period) and collapsed.

    A run is a stretch of words of smallest period q, at least `times` q and
    `least` words long, that no neighbouring word extends. Runs may overlap.
    `collapsed` is the text's words joined by single spaces without those that
    any run holds after its first q words, as the first copy of what is
    repeated stays. Null, empty and blank texts have no words, no runs and an
    empty `collapsed`. Bytes that are no UTF-8 belong to words like others.
    Repeated rows are rows of their own; an empty table gives no rows. Columns
    of `keep` named like a result give way to it; other names clash with
    nothing.

    A text is judged where it is read, without a shuffle; its words take some
    100 bytes each while they are scanned.
    """
    kept = Kept(keep, "n_words", "runs", "collapsed")
    inner = kept.inner
    schema = docs.select(*kept.columns()).schema.add("n_words", "long").add("runs", RUNS_TYPE).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for b in batches:
            done = 0
            for texts in array_slices(b.column("_text"), 1 << 21):
                own = [b.column(c).slice(done, len(texts)) for c in inner]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*own, *runs_of(texts, shape)], [*inner, "n_words", "runs", "collapsed"])

    rows = docs.select(*kept.columns(), F.col("text").cast("string").alias("_text"))
    return kept.restored(rows.mapInArrow(run, schema), "n_words", "runs", "collapsed")
