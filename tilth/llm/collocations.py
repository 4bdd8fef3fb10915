"""Phrases whose words belong together, grown best first under a bound.

A phrase of two to four words that stands a = f(phrase) times is scored by its weakest cut,
floor(2000000 * a / (f(first part) + f(rest))).  A longer phrase y that begins with x stands
at most f(x) times, and cutting it after its first word w gives at most

    bound(x) = floor(2000000 * f(x) / (f(w) + f(x))),

as its rest stands at least as often as y.  The bound falls as x grows, and a phrase's own
score is never above its bound.  So the phrases of score t or more all lie on chains of
prefixes whose bound is t or more: the frontier.

Words and pairs are counted once.  Each round has a threshold for every language (at first
the score of its ``START * limit``-th pair, then of ``GROWTH`` times as many, at last 0), counts
in one pass the triples, and in another the fours, that grow from the frontier or may contain a
phrase of that score, and drops the phrases that a longer one holds ``share`` percent of.  A
language is settled when ``limit`` phrases of its threshold survive, ties included, or when the
threshold is 0; the others go on.  It is enough to look one word further: a phrase that
a much longer one holds is held as often by the part of it that is one word longer.

A frontier is sent to the tasks while it has at most ``FRONTIER_ROWS`` rows and
``FRONTIER_BYTES``; beyond that a pass counts every phrase of its length, with the same result.
Counts are added up in the task, then in Spark, and shuffled by phrase: a frequent phrase is
one row a task.  Nothing else is collected.

Defined results: null texts are empty and have no words; a null language is ``und``; rows of null
or repeated id and repeated rows all count; a language without phrases has no rows; an empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tilth.llm.base import in_tasks, lowered, segments, word_bounds
from tilth.llm.words import word_codes
from tilth.session import staged

LIMIT, LEAST, SHARE = 2000, 30, 80
#: Pairs, in multiples of the limit, whose scores the first round reaches, and the growth of that.
START, GROWTH = 2, 8
FRONTIER_ROWS, FRONTIER_BYTES = 400_000, 16 << 20
#: Bytes of text that a task counts together.
RUN_BYTES = 2 << 20
#: A language's ranking is made in so many parts.
SALT = 32

_BREAK = np.zeros(256, np.int8)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = 1
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[_BREAK == 1] = 32


def _flat(table: pa.Table | None) -> list:
    """Languages, columns of words and flags of a frontier; phrases of one length."""
    if table is None or not table.num_rows:
        return []
    table = table.combine_chunks()
    lists = pc.split_pattern(table["phrase"].combine_chunks().cast(pa.large_binary()), b" ")
    width = len(lists[0])
    words = [pc.list_element(lists, i) for i in range(width)]
    flags = {n: np.asarray(table[n].combine_chunks()) for n in table.column_names if n not in ("lang", "phrase")}
    return [table["lang"].combine_chunks(), words, flags]


class _Run:
    """The words of a run of texts, as numbers that tell language and word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: pa.Array):
        data = lowered(data)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data], dtype=np.int32, out=breaks[1:])
        blanked = _BLANK[data]
        starts, ends = word_bounds(blanked, at)
        codes, self.words = word_codes(blanked, starts, ends)
        row = np.searchsorted(at, starts, side="right") - 1
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        wide = max(1, len(self.words))
        pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * wide + codes
        seen = np.zeros(wide * max(1, len(self.langs)), bool)
        seen[pairs] = True
        self.known = np.flatnonzero(seen)  # language * wide + word
        self.wide, self.size = wide, max(1, len(self.known))
        self.number = np.cumsum(seen) - 1
        self.seen = seen
        self.line = self.number[pairs]
        #: whether the word after a word belongs to the same piece
        self.next = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]]) if len(starts) else np.zeros(0, bool)

    def follow(self, width: int) -> np.ndarray:
        """Places where a phrase of so many words begins."""
        n = len(self.line) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(n, bool)
        for j in range(width - 1):
            ok &= self.next[j : j + n]
        return np.flatnonzero(ok)

    def places(self, frontier: list, width: int) -> tuple[np.ndarray, dict]:
        """For every place the frontier's phrase that begins there (-1: none), and the flags by phrase."""
        out = np.full(len(self.line) + 1, -1, np.int64)
        if not frontier or not len(self.line):
            return out, {}
        langs, words, flags = frontier
        lang = pc.index_in(langs, self.langs).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers, good = [], lang >= 0
        for column in words:
            w = pc.index_in(column, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            good = good & (w >= 0)
            slot = np.where(good, lang * self.wide + w, 0)
            good = good & self.seen[slot]
            numbers.append(self.number[slot])
        kept = np.flatnonzero(good)
        at = self.follow(width)
        if not len(kept) or not len(at):
            return out, {}
        have, want = self.line[at], numbers[0][kept]
        for j in range(1, width):
            # both sides as pairs (rank of what came before, next word)
            want = want * self.size + numbers[j][kept]
            have = have * self.size + self.line[at + j]
            ranked, want = np.unique(want, return_inverse=True)
            rank = np.minimum(np.searchsorted(ranked, have), len(ranked) - 1)
            hit = ranked[rank] == have
            at, have = at[hit], rank[hit]
        order = np.empty(len(ranked), np.int64)
        order[want] = np.arange(len(kept))
        out[at] = order[have]
        return out, {n: f[kept] for n, f in flags.items()}

    def counted(self, at: np.ndarray, width: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(languages, phrases, counts) of the different phrases of ``width`` words that begin there."""
        keys, first = self.line[at], at
        for j in range(1, width):
            keys = keys * self.size + self.line[at + j]
            if j < width - 1:
                keys = np.unique(keys, return_inverse=True)[1]
        if width == 1:
            counts = np.bincount(keys, minlength=self.size)
            numbers = [np.flatnonzero(counts)]
            counts = counts[numbers[0]]
        elif width == 2:
            found, counts = np.unique(keys, return_counts=True)
            numbers = [found // self.size, found % self.size]
        else:
            _, where, counts = np.unique(keys, return_index=True, return_counts=True)
            numbers = [self.line[first[where] + j] for j in range(width)]
        slots = [self.known[n] for n in numbers]
        parts = [self.words.take(pa.array(s % self.wide)) for s in slots]
        phrases = parts[0] if width == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return self.langs.take(pa.array(slots[0] // self.wide)), phrases.cast(pa.binary()).cast(pa.string()), counts


def _passed(docs: DataFrame, count) -> DataFrame:
    """(lang, width, phrase, f): the counts that ``count`` yields for runs of texts, added up."""

    def work(batches):
        for batch in batches:
            for a, b, data, at in segments(batch.column(1), RUN_BYTES):
                run = _Run(data, at, batch.column(0).slice(a, b - a))
                if not len(run.line):
                    continue
                for width, langs, phrases, counts in count(run):
                    if len(counts):
                        widths = pa.array(np.full(len(counts), width, np.int32))
                        made = [langs, widths, phrases, pa.array(counts.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(made, names=["lang", "width", "phrase", "f"])

    made = in_tasks(docs, work, "lang string, width int, phrase string, f long")
    return made.groupBy("lang", "width", "phrase").agg(F.sum("f").alias("f"))


def _first_pass(run: _Run) -> Iterator[tuple]:
    yield 1, *run.counted(np.arange(len(run.line)), 1)
    yield 2, *run.counted(run.follow(2), 2)
    langs = np.bincount(run.known[run.line] // run.wide, minlength=len(run.langs))
    used = np.flatnonzero(langs)
    yield 0, run.langs.take(pa.array(used)), pa.array([""] * len(used)), langs[used]


def _sent(frontier: DataFrame):
    """What gives a task the frontier, broadcast as an Arrow table; or None if it is too large."""
    size = frontier.agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase") + F.octet_length("lang")).alias("b")).first()
    if size.n > FRONTIER_ROWS or (size.b or 0) > FRONTIER_BYTES:
        return None
    table, held = frontier.sparkSession.sparkContext.broadcast(frontier.toArrow()), []

    def read() -> list:
        if not held:
            held.append(_flat(table.value))
        return held[0]

    return read


def _triples(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples that begin with a pair of the frontier or end with one of score (flag ``top``)."""
    sent = _sent(pairs)

    def count(run: _Run):
        at = run.follow(3)
        if sent is not None:
            pair, flags = run.places(sent(), 2)
            top = np.append(flags.get("top", np.zeros(0, bool)), False)
            at = at[(pair[at] >= 0) | top[pair[at + 1]]]
        yield 3, *run.counted(at, 3)

    return _passed(docs, count)


def _fours(docs: DataFrame, triples: DataFrame, others: DataFrame) -> DataFrame:
    """Fours that begin with a triple of the frontier (flag ``grow``) or end with one of score
    (``top``), and the triples that begin with one of the ``others``, pairs."""
    sent, more = _sent(triples), _sent(others)

    def count(run: _Run):
        at, three = run.follow(4), run.follow(3)
        if sent is not None:
            triple, flags = run.places(sent(), 3)
            grow, top = (np.append(flags.get(n, np.zeros(0, bool)), False) for n in ("grow", "top"))
            at = at[grow[triple[at]] | top[triple[at + 1]]]
        if more is not None:
            three = three[run.places(more(), 2)[0][three] >= 0]
        yield 4, *run.counted(at, 4)
        yield 3, *run.counted(three, 3)

    return _passed(docs, count)


def _ratio(a: str, below: str) -> Column:
    """floor(2000000 * a / below), exact beyond 64 bits."""
    return F.expr(f"(CAST(2000000 AS DECIMAL(7, 0)) * CAST({a} AS DECIMAL(20, 0))) div ({below})")


def _sum(x: str, y: str) -> str:
    return f"CAST({x} AS DECIMAL(20, 0)) + CAST({y} AS DECIMAL(20, 0))"


def _words(phrase: str, first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, last - first + 1), " ")


def _scored(phrases: DataFrame, width: int, counts: DataFrame) -> DataFrame:
    """Phrases of one length with a, l, r, score of their weakest cut and ``bound``; ``counts`` has
    (lang, part, f) of all shorter phrases that count."""
    out = phrases.select("lang", "phrase", F.col("f").alias("a"))
    cuts = []
    for k in range(1, width):
        for name, lo, hi in ((f"l{k}", 1, k), (f"r{k}", k + 1, width)):
            part = counts.select("lang", F.col("part").alias(f"{name}p"), F.col("f").alias(name))
            out = out.withColumn(f"{name}p", _words("phrase", lo, hi)).join(part, ["lang", f"{name}p"]).drop(f"{name}p")
        cuts.append(F.struct(
            _ratio("a", _sum(f"l{k}", f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    out = out.withColumn("best", best).withColumn("bound", _ratio("a", _sum("l1", "a")))
    return out.select("lang", "phrase", "a", "best.l", "best.r", "best.score", "bound")


def _thresholds(pairs: DataFrame, langs: DataFrame, reach: int) -> DataFrame:
    """(lang, least): in steps of 1000 the score that ``reach`` pairs have, 0 where there are fewer."""
    steps = pairs.groupBy("lang", F.expr("score div 1000").alias("step")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.col("step").desc())
    upto = steps.withColumn("upto", F.sum("n").over(down))
    found = upto.where(F.col("upto") >= reach).groupBy("lang").agg((F.max("step") * 1000).alias("least"))
    return langs.join(found, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).cast("long").alias("least"))


def collocations(
    docs: DataFrame, limit: int = LIMIT, least: int = LEAST, share: int = SHARE, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Each language's first ``limit`` phrases by score, count (both falling) and bytes: (lang,
    rank, phrase, a, l, r, n, score); ``n`` counts the language's words."""
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = staged(_passed(slim, _first_pass).where((F.col("width") == 0) | (F.col("f") >= least)), "phrases")
    short = base.where("width > 0").select("lang", F.col("phrase").alias("part"), "f")
    pairs = staged(_scored(base.where("width = 2"), 2, short), "pairs")
    open_langs = pairs.select("lang").distinct()
    found, reach = [], START * limit
    while not open_langs.isEmpty():
        levels = staged(_thresholds(pairs, open_langs, reach), "levels")
        settled = staged(_round(slim, pairs, short, levels, least, share), "found")
        sizes = settled.groupBy("lang").agg(F.count("*").alias("n"))
        open_langs = staged(
            levels.join(sizes, "lang", "left").where(F.coalesce("n", F.lit(0)) < limit).where("least > 0").select("lang"), "open")
        found.append(settled.join(open_langs, "lang", "left_anti"))
        reach *= GROWTH
    if not found:
        found = [pairs.select("lang", "phrase", "a", "l", "r", "score")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # ranked in parts first, so that no task ranks all phrases of a language
    parted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    parted = parted.withColumn("line", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = parted.where(F.col("line") <= limit).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = base.where("width = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= limit).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _round(slim: DataFrame, pairs: DataFrame, short: DataFrame, levels: DataFrame, least: int, share: int) -> DataFrame:
    """All surviving phrases of each language's threshold or more."""
    docs = slim.join(levels.select("lang"), "lang", "left_semi")
    reached = pairs.join(levels, "lang")
    two = staged(reached.where("bound >= least").withColumn("top", F.expr("score >= least")), "frontier")
    three = staged(_triples(docs, two.select("lang", "phrase", "top")).where(F.col("f") >= least), "triples")
    scored = _scored(three, 3, short).join(levels, "lang")
    tri = staged(scored.withColumns({"grow": F.expr("bound >= least"), "top": F.expr("score >= least")}), "triples")
    grow = tri.where("grow").select("lang", _words("phrase", 2, 3).alias("phrase")).distinct()
    others = grow.join(two.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    more = staged(_fours(docs, tri.where("grow OR top").select("lang", "phrase", "grow", "top"), others).where(F.col("f") >= least), "fours")
    known = three.unionByName(more.where("width = 3")).dropDuplicates(["lang", "phrase"])
    longer = known.unionByName(more.where("width = 4"))
    counts = short.unionByName(known.select("lang", F.col("phrase").alias("part"), "f"))
    four = _scored(more.where("width = 4"), 4, counts).join(levels, "lang").where("score >= least")
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    top = two.where("top").select(columns).unionByName(tri.where("top").select(columns)).unionByName(four.select(columns))
    size = F.col("width")
    held = longer.select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(F.split("phrase", " "), F.lit(1), size - 1), " "),
        F.array_join(F.slice(F.split("phrase", " "), F.lit(2), size - 1), " "))).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = "CAST({} AS DECIMAL(20, 0)) * CAST({} AS DECIMAL(10, 0))"
    dropped = F.expr(f"{wide.format('most', 100)} >= {wide.format('a', share)}")
    return top.join(most, ["lang", "phrase"], "left").where(F.coalesce(~dropped, F.lit(True))).select(columns)
