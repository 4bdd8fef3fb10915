"""Near-duplicates by joining signature coordinates.

A document's signature has one minimum hash per coordinate.  Documents are posted under
their coordinate-value pairs; two documents are candidates when they meet in enough lists.
Prefix rule: documents that meet at least ``matches`` times meet in one of the rarest
``coordinates - matches + 1`` lists of each, so only those are joined; the remaining, longer
lists are skipped and only looked up (as the two signatures) for documents that have met.
Candidates with too few collisions go; the others are confirmed on their full shingle sets.

Documents of equal sets are one class and one row from the start.  Documents of a list are
not paired with each other at once: first each with the smallest of its lists, then with
the smallest of every list, and after that only documents of one list that are still in
different components.  Links inside a component would change nothing, so none is lost.
Long lists are compared in blocks by bitmaps of the sets, which bound the similarity from
above; only pairs that the bound lets through become rows.

Defined results: null and empty texts, and texts of white space only, have no shingles and
no links; repeated or null ids are told apart by their rows (the component is still named
by the smallest id); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.llm.blocks import spread_over
from tilth.llm.base import bounded, in_tasks, keyed, lowered, mixed, segments, shingle_hashes
from tilth.llm.components import components
from tilth.session import staged

WORDS = 5
PERCENT = 80
#: Coordinates of a signature, and collisions that make a candidate.  At the similarity 0.8
#: a pair has 25.6 collisions on average; fewer than 14 come up about once in 100,000 pairs.
COORDINATES = 32
MATCHES = 14
#: Lists of more documents are compared in blocks; documents of a block; bits of a bitmap for each shingle.
LONG_LIST = 16
BLOCK = 256
BITS = 16

_ODD = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_PLUS = mixed(np.arange(1001, 1257, dtype=np.uint64))


def _sets(body: pa.Array, width: int):
    """(first row, row after the last, sorted distinct shingles, their rows) of runs of texts."""
    for first, last, data, at in segments(body):
        hashes, rows = shingle_hashes(lowered(data), at, width)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        yield first, last, hashes[fresh], rows[fresh]


def signatures(docs: DataFrame, width: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """(key, n, mark_a, mark_b, tokens): set size, fingerprint of the set, coordinate-value pairs."""

    def work(batches):
        for batch in batches:
            for first, last, hashes, rows in _sets(batch.column(1), width):
                n = last - first
                sizes = np.bincount(rows, minlength=n)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                full = np.flatnonzero(sizes)
                at = starts[:-1][full]
                tokens = np.zeros((n, coordinates), np.uint64)
                marks = np.zeros((2, n), np.uint64)
                if len(full):
                    for i in range(coordinates):
                        low = np.minimum.reduceat(hashes * _ODD[i] + _PLUS[i], at)
                        tokens[full, i] = mixed(low + _PLUS[-1 - i])
                    marks[0, full] = np.add.reduceat(mixed(hashes + np.uint64(11)), at)
                    marks[1, full] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
                lists = np.concatenate([[0], np.cumsum(np.where(sizes > 0, coordinates, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes.astype(np.int64)),
                     pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(tokens[full].reshape(-1).view(np.int64)))],
                    ["key", "n", "mark_a", "mark_b", "tokens"])

    return in_tasks(docs.select("key", "text"), work, "key long, n long, mark_a long, mark_b long, tokens array<long>")


def shingle_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(key, shingles): the whole set of a document, sorted."""

    def work(batches):
        for batch in batches:
            for first, last, hashes, rows in _sets(batch.column(1), width):
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=last - first))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["key", "shingles"])

    return in_tasks(docs.select("key", "text"), work, "key long, shingles array<long>")


def _width(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the bitmap of a set of n shingles, a power of two."""
    return 1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) * BITS / 64)), 0).astype(np.int64)


def bitmaps(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(key, n, bits): a bit for each shingle's hash modulo the size of the bitmap."""

    def work(batches):
        for batch in batches:
            for first, last, hashes, rows in _sets(batch.column(1), width):
                sizes = np.bincount(rows, minlength=last - first)
                words = _width(sizes)
                starts = np.concatenate([[0], np.cumsum(words)])
                bits = np.zeros(starts[-1], np.uint64)
                place = hashes & (words[rows].astype(np.uint64) * np.uint64(64) - np.uint64(1))
                np.bitwise_or.at(bits, starts[:-1][rows] + (place >> np.uint64(6)).astype(np.int64),
                                 np.uint64(1) << (place & np.uint64(63)))
                raw, ends = bits.tobytes(), (starts * 8).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes.astype(np.int64)),
                     pa.array([raw[x:y] for x, y in zip(ends, ends[1:])], pa.binary())], ["key", "n", "bits"])

    return in_tasks(docs.select("key", "text"), work, "key long, n long, bits binary")


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Bitmaps brought to ``words`` words: halves of a larger one are laid over each other."""
    rows = [np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in bits]
    return np.array(rows).reshape(len(rows), words)


def _close(a: tuple, b: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks that may be similar enough; a block is (part, n, bitmaps)."""
    found = [], []
    widths = [_width(x[1]) for x in (a, b)]
    for wa in np.unique(widths[0]):
        for wb in (wa // 2, wa, wa * 2):
            at = [np.flatnonzero(w == v) for w, v in zip(widths, (wa, wb))]
            if not len(at[0]) or not len(at[1]):
                continue
            words = min(wa, wb)
            maps = [_folded([x[2][i] for i in rows], words) for x, rows in zip((a, b), at)]
            part, n = ([x[k][rows] for x, rows in zip((a, b), at)] for k in (0, 1))
            for i in range(len(at[0])):
                n_a = n[0][i]
                j = np.flatnonzero((part[1] != part[0][i]) & (100 * np.minimum(n[1], n_a) >= percent * np.maximum(n[1], n_a)))
                if not len(j):
                    continue
                only_a = np.bitwise_count(maps[0][i] & ~maps[1][j]).sum(axis=1, dtype=np.int64)
                only_b = np.bitwise_count(~maps[0][i] & maps[1][j]).sum(axis=1, dtype=np.int64)
                most = np.minimum(n_a - only_a, n[1][j] - only_b)
                j = j[100 * most >= percent * (n_a + n[1][j] - most)]
                found[0].append(np.full(len(j), at[0][i]))
                found[1].append(at[1][j])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in found)


def close_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one list and different parts that their bitmaps do not rule out.

    ``members`` has token, many (size of the list), key, part, n and bits.  A list is dealt
    into blocks, and a task compares two blocks of a list at a time.
    """
    line = F.pmod(F.xxhash64("key", F.lit(5)), F.ceil(F.col("many") / BLOCK)).cast("int")
    dealt = members.withColumn("lines", F.ceil(F.col("many") / BLOCK).cast("int")).withColumn("line", line)
    shape = "token long, lines int, line int, keys binary, parts binary, sizes binary, bits array<binary>"
    schema = pa.schema([("token", pa.int64()), ("lines", pa.int32()), ("line", pa.int32()), ("keys", pa.binary()),
                        ("parts", pa.binary()), ("sizes", pa.binary()), ("bits", pa.list_(pa.binary()))])

    def pack(table: pa.Table) -> pa.Table:
        fixed = [[table.column(c)[0].as_py()] for c in ("token", "lines", "line")]
        numbers = [[table.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("key", "part", "n")]
        return pa.table([*fixed, *numbers, [table.column("bits").to_pylist()]], schema=schema)

    blocks = staged(dealt.groupBy("token", "line").applyInArrow(pack, shape), "blocks")
    left = blocks.select("token", F.col("line").alias("to"), *[F.col(c).alias(f"l_{c}") for c in ("keys", "parts", "sizes", "bits")])
    right = spread_over(blocks, "to", F.col("lines")).where("to <= line")
    pairs = left.join(right, ["token", "to"]).select("l_keys", "l_parts", "l_sizes", "l_bits", "keys", "parts", "sizes", "bits")

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                numbers = [np.frombuffer(batch.column(i)[row].as_buffer(), np.int64) for i in (0, 1, 2, 4, 5, 6)]
                bits = [batch.column(i)[row].as_py() for i in (3, 7)]
                x, y = _close((numbers[1], numbers[2], bits[0]), (numbers[4], numbers[5], bits[1]), percent)
                a, b = numbers[0][x], numbers[3][y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return in_tasks(pairs, work, "a long, b long")


def postings(signed: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(token, key) of the lists that are joined: of each document's lists that hold others too,
    the rarest ones that its collisions cannot all avoid."""
    every = signed.select("key", F.explode("tokens").alias("token"))
    shared = every.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    met = every.join(shared, "token")
    own = Window.partitionBy("key")
    # lists of one document would come first in the order and are gone already
    return (
        met.withColumn("line", F.row_number().over(own.orderBy("many", "token")))
        .withColumn("lists", F.count("*").over(own))
        .where(F.col("line") <= F.col("lists") - F.lit(matches - 1))
        .select("token", "key")
    )


def confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, width: int, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) that collide often enough and whose full sets are similar enough."""
    sides = [signed.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "ab"]
    alike = (
        pairs.join(sides[0], "a").join(sides[1], "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(F.size(F.array_intersect("t_a", "t_b")) >= matches)
        .select("a", "b")
    )
    alike = staged(alike, "candidates")
    named = alike.select(F.col("a").alias("key")).unionByName(alike.select(F.col("b").alias("key"))).distinct()
    sets = staged(shingle_sets(docs.join(bounded(named), "key"), width), "shingles")
    sides = [sets.select(F.col("key").alias(s), F.col("shingles").alias(f"s_{s}")) for s in "ab"]
    both = F.size(F.array_intersect("s_a", "s_b"))
    near = 100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)
    return staged(alike.join(sides[0], "a").join(sides[1], "b").where(near).select("a", "b"), "near")


def _placed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(token, key, part): the postings with the component of each document so far."""
    parts = components(links).select(F.col("node").alias("key"), "component")
    return lists.join(parts, "key", "left").select("token", "key", F.coalesce("component", "key").alias("part"))


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES,
                    matches: int = MATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id, n_shingles, component_key, component_id, kept) of every row of ``docs``."""
    return _near_duplicates(*keyed(docs, key, text), width, percent, coordinates, matches)


def _near_duplicates(texts: DataFrame, plain: bool, width: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    signed = staged(signatures(texts, width, coordinates), "signatures")
    classes = signed.where("n > 0").groupBy("mark_a", "mark_b", "n").agg(F.min("key").alias("class"))
    members = signed.select("key", "n", "mark_a", "mark_b").join(classes, ["mark_a", "mark_b", "n"], "left")
    members = staged(members.select("key", F.col("n").alias("n_shingles"), F.coalesce("class", "key").alias("class")), "classes")
    firsts = members.where("key = class AND n_shingles > 0").select("key")
    alone = staged(signed.join(firsts, "key", "left_semi").select("key", "n", "tokens"), "representatives")
    lists = staged(postings(alone, coordinates, matches), "postings")
    hubs = staged(lists.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("many")).where("many > 1"), "hubs")
    stars = lists.join(hubs.select("token", "hub"), "token").where("hub < key")

    links = confirmed(
        stars.groupBy("key").agg(F.min("hub").alias("a")).select("a", F.col("key").alias("b")),
        alone, texts, width, matches, percent)
    # the other hubs of each list
    placed = _placed(lists, links)
    hub_parts = placed.select("token", F.col("key").alias("hub"), F.col("part").alias("hub_part"))
    stars = placed.join(hubs.select("token", "hub").join(hub_parts, ["token", "hub"]), "token")
    pairs = stars.where("hub < key AND hub_part <> part").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    tried = staged(pairs, "pairs")
    links = links.unionByName(confirmed(tried, alone, texts, width, matches, percent))
    # documents of one list that are still in different components
    placed = _placed(lists, links)
    parted = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("many"))
    parted = parted.where("low < high").select("token", "many")
    split = staged(placed.join(parted, "token").join(alone.select("key", "n"), "key"), "parted")
    few, many = split.where(F.col("many") <= LONG_LIST), split.where(F.col("many") > LONG_LIST)
    left = few.select("token", F.col("key").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("n_a"))
    right = few.select("token", F.col("key").alias("b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"))
    fits = F.expr(f"a < b AND part_a <> part_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = left.join(right, "token").where(fits).select("a", "b")
    named = many.select("key").distinct()
    maps = staged(bitmaps(texts.join(bounded(named), "key", "left_semi"), width), "bitmaps")
    pairs = pairs.unionByName(close_pairs(many.join(maps.select("key", "bits"), "key"), percent))
    pairs = staged(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(confirmed(pairs, alone, texts, width, matches, percent))
    parts = components(links)
    named = members.join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
    named = named.select("key", "n_shingles", F.coalesce("component", "class").alias("component_key"))
    if plain:
        out = named.withColumn("id", F.col("key")).withColumn("component_id", F.col("component_key"))
    else:
        ids = texts.select("key", "id")
        out = named.join(ids, "key").join(
            ids.select(F.col("key").alias("component_key"), F.col("id").alias("component_id")), "component_key")
    return out.select(
        "key", "id", "n_shingles", "component_key", "component_id", (F.col("key") == F.col("component_key")).alias("kept"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES,
             matches: int = MATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component; documents without shingles all stay."""
    texts, plain = keyed(docs, key, text)
    kept = _near_duplicates(texts, plain, width, percent, coordinates, matches).where("kept")
    return texts.join(kept.select("key"), "key", "left_semi").select("row.*")
