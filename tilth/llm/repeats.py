"""Exact removal of repeated substrings by prefix-free parsing.

A rolling hash picks triggers: of the 32-byte grams of every ``length``-byte window the one
of the smallest hash.  Windows of one trigger are neighbours; the bytes they cover make a
phrase.  Phrases overlap, no window lies in two, and equal windows lie in phrases of the
same trigger at the same place, wherever they stand.  So

1. equal phrases are one entry of the dictionary; the parse lists where each stands, and all
   but its first place in corpus order (document, then offset) are repeated as a whole;
2. triggers with a single phrase are settled by that.  Only where different phrases share a
   trigger are the entries' suffixes needed: every window of the entry's first place, cut to
   ``length`` bytes, is put in order with its equals, and all but the first are repeated.

Full suffix arrays of dictionary and parse would order all suffixes; equality over
``length`` bytes is all that is asked, so only heads of that length are brought together,
by a 64-bit hash, and put in corpus order.

Hot passages: a task drops what it has seen before (its later places are repeated whatever
the rest of the corpus holds), and a trigger that meets many phrases within a task is sent
on by window, so that no task gets more than a few rows of one trigger from each other task.

Defined results: a null text is empty; texts under ``length`` bytes have no window and lose
nothing; rows with null or repeated ids are put in the order of id (null last) and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.llm.base import BROADCAST_ROWS, bounded, grams_of, hash_of, in_tasks, keyed, rolling, segments
from tilth.session import staged

LENGTH = 100
GRAM = 32
#: Bytes of text parsed together.
SEGMENT = 1 << 20
#: Different phrases of one trigger in a segment, beyond which its windows travel by themselves.
MOST_PHRASES = 4
#: Phrases met so often in a segment are remembered by the task.
OFTEN = 4

# kinds of rows: a phrase, a trigger known to be ambiguous, a window, a repeated span
PHRASE, AMBIGUOUS, WINDOW, SPAN = range(4)
ROWS = "kind byte, h long, c long, key long, lo int, n int"


def _parse(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Phrases of a segment: document, offset of the first window, number of windows, trigger
    hash, phrase hash; and the prefix sums of the segment."""
    prefix = rolling(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), prefix
    places = np.arange(len(data) - gram + 1)
    hashes = grams_of(prefix, gram)
    # hash and place in one number: the smallest is the leftmost gram of the smallest hash
    best = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    owner = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(at)
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(owner)]
    fits = np.arange(len(owner)) + length <= at[1:][of]
    starts = fits.copy()
    starts[1:] &= (owner[1:] != owner[:-1]) | ~fits[:-1]
    first = np.flatnonzero(starts)
    ends = fits.copy()
    ends[:-1] &= (owner[1:] != owner[:-1]) | ~fits[1:]
    last = np.flatnonzero(ends)
    trigger = owner[first]
    many = last - first + 1
    whole = hash_of(prefix, first, last + length)
    place = ((trigger - first).astype(np.uint64) << np.uint64(32)) | many.astype(np.uint64)
    whole = whole * np.uint64(0x9FB21C651E98DF25) + place
    return of[first], first - at[of[first]], many, hashes[trigger], whole, prefix


def _firsts(groups: tuple, key: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows come first in corpus order among the rows of equal ``groups``."""
    order = np.lexsort((lo, key, *groups))
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for g in groups:
        s = g[order]
        fresh[1:] |= s[1:] != s[:-1]
    out = np.zeros(len(order), bool)
    out[order[fresh]] = True
    return out


def _merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.cumsum(fresh)
    reach = np.maximum.accumulate((rank << 32) + hi)
    fresh[1:] |= (rank[1:] << 32) + lo[1:] > reach[:-1]
    starts = np.flatnonzero(fresh)
    return key[starts], lo[starts], np.maximum.reduceat(hi, starts)


def _rows(kind: int, h, c, key, lo, n) -> pa.RecordBatch:
    size = len(key)
    fill = lambda x, t: np.full(size, x, t) if np.isscalar(x) else np.asarray(x).astype(t, copy=False)
    signed = lambda x: pa.array(fill(x, np.int64) if np.isscalar(x) else np.asarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(fill(kind, np.int8)), signed(h), signed(c), pa.array(fill(key, np.int64)),
         pa.array(fill(lo, np.int32)), pa.array(fill(n, np.int32))], ["kind", "h", "c", "key", "lo", "n"])


def _spans(key, lo, hi) -> pa.RecordBatch:
    """Repeated spans: ``lo`` and their length in ``n``."""
    key, lo, hi = _merged(key, lo, hi)
    return _rows(SPAN, key, 0, key, lo, hi - lo)


def _each(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and start of every window of phrases of ``n`` windows from ``lo``."""
    rows = np.repeat(np.arange(len(n)), n)
    return rows, lo[rows] + np.arange(len(rows)) - (np.cumsum(n) - n)[rows]


def _windows(prefix, at, doc, key, lo, n, length):
    """Rows of the windows of the given phrases: the first of equal ones, and spans of the others."""
    rows, start = _each(lo, n)
    place = at[doc[rows]] + start
    h = hash_of(prefix, place, place + length)
    first = _firsts((h,), key[rows], start)
    yield _rows(WINDOW, h[first], 0, key[rows][first], start[first], 1)
    yield _spans(key[rows][~first], start[~first], start[~first] + length)


def parse(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_PHRASES) -> DataFrame:
    """Phrases of all documents (key, text), and what a task can say of them by itself."""

    def work(batches):
        ambiguous = np.zeros(0, np.uint64)
        known: dict[int, tuple[int, int]] = {}  # frequent phrases and their first place so far
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, at in segments(batch.column(1), SEGMENT):
                doc, lo, n, h, c, prefix = _parse(data, at, length, gram)
                if not len(doc):
                    continue
                key = keys[first:last][doc]
                fresh = _firsts((h, c), key, lo)
                repeated = ~fresh
                if known:
                    for i in np.flatnonzero(fresh & np.isin(c, np.fromiter(known, np.uint64, len(known)))):
                        before = known[int(c[i])]
                        if before < (int(key[i]), int(lo[i])):
                            fresh[i], repeated[i] = False, True
                        else:
                            known[int(c[i])] = (int(key[i]), int(lo[i]))
                if repeated.any():
                    yield _spans(key[repeated], lo[repeated], lo[repeated] + n[repeated] + length - 1)
                    again, times = np.unique(c[repeated], return_counts=True)
                    often = fresh & np.isin(c, again[times >= OFTEN])
                    if len(known) < 1 << 16:
                        known.update(zip(c[often].tolist(), zip(key[often].tolist(), lo[often].tolist())))
                doc, key, lo, n, h, c = (x[fresh] for x in (doc, key, lo, n, h, c))
                values, times = np.unique(h, return_counts=True)
                new = np.setdiff1d(values[times > most], ambiguous)
                if len(new):
                    ambiguous = np.union1d(ambiguous, new)
                    yield _rows(AMBIGUOUS, new, 0, np.zeros(len(new), np.int64), 0, 0)
                alone = np.isin(h, ambiguous)
                if alone.any():
                    yield from _windows(prefix, at, doc[alone], key[alone], lo[alone], n[alone], length)
                rest = ~alone
                if rest.any():
                    yield _rows(PHRASE, h[rest], c[rest], key[rest], lo[rest], n[rest])

    return in_tasks(docs.select("key", "text"), work, ROWS)


def _whole(batches) -> dict | None:
    """All rows of a partition as arrays (partitions are as large as the session's shuffle partitions)."""
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.concat_tables(parts)
    return {name: table.column(name).to_numpy() for name in table.column_names}


def settled(parsed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Phrases brought together by trigger: repeated spans, phrases to look into (kind PHRASE),
    and the windows and spans that came along."""

    def work(batches):
        rows = _whole(batches)
        if rows is None:
            return
        kind = rows["kind"]
        for other in (WINDOW, SPAN):
            if (at := kind == other).any():
                yield _rows(other, rows["h"][at], 0, rows["key"][at], rows["lo"][at], rows["n"][at])
        at = kind == PHRASE
        h, c, key, lo, n = (rows[x][at] for x in ("h", "c", "key", "lo", "n"))
        if not len(h):
            return
        first = _firsts((c, h), key, lo)
        if not first.all():
            yield _spans(key[~first], lo[~first], lo[~first] + n[~first] + length - 1)
        h, key, lo, n = (x[first] for x in (h, key, lo, n))
        values, times = np.unique(h, return_counts=True)
        unclear = np.union1d(values[times > 1], rows["h"][kind == AMBIGUOUS])
        at = np.isin(h, unclear)
        if at.any():
            yield _rows(PHRASE, h[at], 0, key[at], lo[at], n[at])

    return in_tasks(parsed.repartition("h"), work, ROWS)


def looked_into(phrases: DataFrame, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The windows of unclear phrases, taken from their documents."""
    wanted = phrases.groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    wanted = staged(wanted, "unclear")
    named = docs.select("key", "text").join(bounded(wanted.select("key")), "key", "left_semi")
    rows = named.join(wanted, "key")

    def work(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, at in segments(batch.column(1)):
                lists = [batch.column(i).slice(first, last - first) for i in (2, 3)]
                doc = np.repeat(np.arange(last - first), lists[0].value_lengths().to_numpy(zero_copy_only=False))
                lo, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                yield from _windows(rolling(data), at, doc, keys[first:last][doc], lo, n, length)

    return in_tasks(rows.select("key", "text", "lo", "n"), work, ROWS)


def compared(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (key, lo, hi) of all windows but the first of equal ones, and the spans that came along."""
    slim = rows.select("h", "key", "lo", F.when(F.col("kind") == SPAN, F.col("n")).otherwise(0).alias("n"))

    def work(batches):
        held = _whole(batches)
        if held is None:
            return
        at = held["n"] == 0
        h, key, lo = (held[x][at] for x in ("h", "key", "lo"))
        late = ~_firsts((h,), key, lo)
        key = np.concatenate([key[late], held["key"][~at]])
        hi = np.concatenate([lo[late] + length, (held["lo"] + held["n"])[~at]])
        key, lo, hi = _merged(key, np.concatenate([lo[late], held["lo"][~at]]), hi)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["key", "lo", "hi"])

    return in_tasks(slim.repartition("h"), work, "key long, lo int, hi int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_PHRASES) -> DataFrame:
    """(key, spans): the maximal repeated byte ranges [lo, hi) of the documents (key, text) that have any."""
    first = staged(settled(parse(docs, length, gram, most), length), "phrases")
    second = looked_into(first.where(F.col("kind") == PHRASE), docs, length)
    windows = first.where(F.col("kind") == WINDOW).unionByName(second)
    early = first.where(F.col("kind") == SPAN).select("key", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    every = early.unionByName(compared(windows, length))
    own = Window.partitionBy("key").orderBy("lo", "hi")
    reach = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", F.when(reach >= F.col("lo"), 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return staged(merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")


def _with_spans(texts: DataFrame, length: int) -> DataFrame:
    """Documents beside their spans, as arrays lo and hi (null: none)."""
    spans = repeated_spans(texts, length)
    many = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    side = F.broadcast(spans) if many <= BROADCAST_ROWS else spans
    return texts.join(side, "key", "left").select("key", "id", "text", "row", "spans.lo", "spans.hi")


def _kept(raw: bytes, los: list | None, his: list | None) -> tuple[list[memoryview], int]:
    """What stays of the bytes, and how many go."""
    view, pieces, at, gone = memoryview(raw), [], 0, 0
    for lo, hi in zip(los or [], his or []):
        pieces.append(view[at:lo])
        gone += hi - lo
        at = hi
    pieces.append(view[at:])
    return pieces, gone


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, id, n_bytes, n_removed, n_spans, kept) of every document, ``kept`` as bytes; with
    ``digest`` kept_sha256 in its place, so that the bytes need not travel on."""
    rows = _with_spans(keyed(docs, key, text)[0], length).select("key", "id", "text", "lo", "hi")
    last = "kept_sha256" if digest else "kept"

    def work(batches):
        for batch in batches:
            kept, removed, many, sizes = [], [], [], []
            los, his = batch.column(3), batch.column(4)
            for i, body in enumerate(batch.column(2).cast(pa.binary())):
                raw, ends = body.as_py(), his[i].as_py()
                pieces, gone = _kept(raw, los[i].as_py(), ends)
                if digest:
                    sha = hashlib.sha256()
                    for piece in pieces:
                        sha.update(piece)
                    kept.append(sha.hexdigest())
                else:
                    kept.append(b"".join(pieces))
                sizes.append(len(raw))
                removed.append(gone)
                many.append(len(ends or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, removed, many)),
                 pa.array(kept, pa.string() if digest else pa.binary())],
                ["key", "id", "n_bytes", "n_removed", "n_spans", last])

    kind = "string" if digest else "binary"
    return in_tasks(rows, work, f"key long, id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")


def stripped(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts.

    Bytes of a character that was cut through go with it; a document of which nothing is
    left goes; a column ``size`` is brought up to date.  Untouched rows stay as they are.
    """
    rows = _with_spans(keyed(docs, key, text)[0], length).select("row", "text", "lo", "hi")

    def work(batches):
        for batch in batches:
            los, his = batch.column(2), batch.column(3)
            texts = [
                b"".join(_kept(body.as_py(), los[i].as_py(), his[i].as_py())[0]).decode("utf-8", "ignore") if his[i].is_valid else None
                for i, body in enumerate(batch.column(1).cast(pa.binary()))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "left"])

    schema = rows.select("row").schema.add("left", "string")
    done = in_tasks(rows, work, schema).where("left IS NULL OR left <> ''")
    now = F.coalesce("left", F.col("row")[text])
    changed = {text: now, size: F.when(F.col("left").isNull(), F.col("row").getField(size)).otherwise(F.length("left"))} if size in docs.columns else {text: now}
    kinds = dict(docs.dtypes)
    return done.select(*[(changed[c].cast(kinds[c]) if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])
