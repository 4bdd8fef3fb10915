"""Runs of words that repeat with a period, found by minimizers of several scales.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and
``repeats`` (four or more) periods long, which neither neighbouring word extends.  Periods up to
``LAGS`` are too short for minimizers: the words are compared with those q places before,
for each q.  For longer ones there is a scale s = 16, 32, ..., which finds periods over s/2
and up to s:

* Every place has the hash of the s words from there.  Inside a run of period q <= s such
  a hash comes back after q words and not before.
* Places whose hash is the least of a window of s/2 places are the scale's minimizers.  Where
  a window and the one q places on lie in the run, both choose the same place of the period,
  so neighbouring equal minimizers stand q apart.
* A run of four periods holds such a pair: q + s/2 + s - 1 <= 4q for q > s/2.
* A pair seeds its run, which is extended to both sides by comparing words.

Words are numbers given by their bytes, so that what is compared is the words themselves;
hashes choose seeds and a seed is confirmed on its words.  Documents are joined with a
word of its own after each, which no run can contain, and a scale looks only at documents
long enough for it.  The work is about linear in the words for each scale and there are
log2(words) of these.  Rows stay where they are read: nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no words, no runs and an
empty collapsed text; a null id is an id like any other here; repeated rows each have their
own row; a table without rows gives none; extra columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilth.llm.base import in_tasks, mixed, segments, word_bounds
from tilth.llm.words import word_codes

#: Periods up to here are found by direct lag scans.
LAGS = 8


def _joined(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of several documents with a word of its own after each; and each document's place."""
    docs = len(first) - 1
    out = np.empty(len(words) + docs, np.int64)
    gaps = first[1:] + np.arange(docs)
    inside = np.ones(len(out), bool)
    inside[gaps] = False
    out[inside] = words
    out[gaps] = -1 - np.arange(docs)
    return out, first[:-1] + np.arange(docs)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _lag_runs(line: np.ndarray, period: int, least: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    if len(line) <= period:
        return
    starts, ends = _stretches(line[:-period] == line[period:])
    long = ends - starts + period >= max(least, repeats * period)
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        yield s, e + period, period


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some window of so many places."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, window, np.minimum)
    # the greatest of the minima of the windows that hold a place is its own hash if one of them chose it
    edge = np.zeros(window - 1, np.uint64)
    greatest = _sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    return np.flatnonzero(greatest == hashes)


def _extended(line: np.ndarray, lo: int, hi: int, period: int) -> tuple[int, int]:
    """The longest stretch of this period around [lo, hi)."""
    step = 64
    while lo > 0:
        a = max(0, lo - step)
        differ = np.flatnonzero(line[a:lo] != line[a + period : lo + period])
        if len(differ):
            lo = a + int(differ[-1]) + 1
            break
        lo, step = a, step * 2
    n, step = len(line), 64
    while hi < n:
        b = min(n, hi + step)
        differ = np.flatnonzero(line[hi:b] != line[hi - period : b - period])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = b, step * 2
    return lo, hi


def _seeded_runs(line: np.ndarray, hashes: np.ndarray, size: int, least: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """Runs of periods over size/2 and up to ``size`` from neighbouring equal minimizers."""
    places = _minimizers(hashes, size // 2)
    if len(places) < 2:
        return
    order = np.argsort(hashes[places], kind="stable")
    a, b = places[order[:-1]], places[order[1:]]
    apart = b - a
    pair = (hashes[a] == hashes[b]) & (apart > size // 2) & (apart <= size)
    a, apart = a[pair], apart[pair]
    order = np.lexsort((a, apart))
    done_period, done_to = 0, 0
    for place, period in zip(a[order].tolist(), apart[order].tolist()):
        if period == done_period and place + period + size <= done_to:
            continue  # inside the run found last
        if not np.array_equal(line[place : place + size], line[place + period : place + period + size]):
            continue
        lo, hi = _extended(line, place, place + period + size, period)
        done_period, done_to = period, hi
        if hi - lo >= max(least, repeats * period):
            yield lo, hi, period


def runs_of(words: np.ndarray, first: np.ndarray, least: int = 6, repeats: int = 4) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, in order of document, start and period.

    ``words`` are the numbers of the words of documents ``first[i]`` to ``first[i + 1]``.
    """
    sizes = np.diff(first)
    found: dict[tuple[int, int], int] = {}

    def note(runs, offset: np.ndarray, back: np.ndarray) -> None:
        # places in the joined line become places among all words
        for lo, hi, period in runs:
            doc = int(np.searchsorted(offset, lo, side="right")) - 1
            start = lo - int(offset[doc]) + int(first[back[doc]])
            key = (start, start + hi - lo)
            found[key] = min(period, found.get(key, period))

    def pick(enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        back = np.flatnonzero(enough)
        inside = np.repeat(enough, sizes)
        at = np.concatenate(([0], np.cumsum(sizes[back])))
        line, offset = _joined(words[inside], at)
        return line, offset, back

    line, offset, back = pick(sizes >= least)
    if not len(back):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    for period in range(1, LAGS + 1):
        note(_lag_runs(line, period, least, repeats), offset, back)
    size = 2 * LAGS
    while (enough := sizes >= max(least, repeats * (size // 2 + 1))).any():
        line, offset, back = pick(enough)
        # the hash of a place covers the next words, twice as many at every step
        hashes, have = mixed(line.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        while have < size:
            hashes = mixed(hashes[:-have] * np.uint64(0xD6E8FEB86659FD93) + hashes[have:])
            have *= 2
        note(_seeded_runs(line, hashes, size, least, repeats), offset, back)
        size *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rows = np.array([(s, e - s, q) for (s, e), q in found.items()], np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    doc = np.searchsorted(first, rows[:, 0], side="right") - 1
    return doc, rows[:, 0] - first[doc], rows[:, 1], rows[:, 2]


def periodic_runs(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), least: int = 6, repeats: int = 4
) -> DataFrame:
    """The carried columns, ``n_words``, ``runs`` (structs of start, length and period, by start
    and period) and ``collapsed``: the words no run repeats, joined by one space.

    A word is left out if a run holds it after that run's first period.
    """
    if repeats < 4:
        raise ValueError("minimizers find runs of four periods or more")
    slim = docs.select(*[F.col(c) for c in carry], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    schema = f"{shown}{', ' if shown else ''}n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def work(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b, data, at in segments(texts):
                starts, ends = word_bounds(data, at)
                first = np.searchsorted(starts, at)
                doc, start, length, period = runs_of(word_codes(data, starts, ends)[0], first, least, repeats)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(run)),
                )
                steps = np.zeros(len(starts) + 1, np.int64)
                np.add.at(steps, first[doc] + start + period, 1)
                np.add.at(steps, first[doc] + start + length, -1)
                kept = np.cumsum(steps[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)),
                     pa.array(np.diff(first)), listed, _collapsed(data, starts, ends, first, kept)],
                    names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
                )

    return in_tasks(slim, work, schema)


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of every document, joined by one space."""
    s, e = starts[kept], ends[kept]
    docs = len(first) - 1
    of = np.repeat(np.arange(docs), np.diff(first))[kept]
    space = np.ones(len(s), np.int64)  # one after every word but a document's last
    space[np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else []] = 0
    sizes = e - s + space
    to = np.cumsum(sizes)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    if len(s):
        sources = np.repeat(s - (to - sizes), sizes) + np.arange(len(out))
        last = np.repeat(to, sizes) - 1 == np.arange(len(out))
        word = ~(last & np.repeat(space.astype(bool), sizes))
        out[word] = data[sources[word]]
    at = np.zeros(docs + 1, np.int64)
    np.cumsum(np.bincount(of, weights=sizes, minlength=docs).astype(np.int64) if len(of) else np.zeros(docs, np.int64), out=at[1:])
    raw = pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(at), pa.py_buffer(out)])
    return raw.cast(pa.string())
