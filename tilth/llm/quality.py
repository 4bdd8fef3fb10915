"""Quality scores learnt from preferences, after Bradley and Terry.

A document's strength is a weighted sum of features of its bytes.  The weights are learnt
from pairs of a good and a bad document by the logistic loss of the features' difference
(no constant: it cancels in a pair).  Strengths become scores between 0 and 1 such that
the strength at the chosen quantile of the learning rows stands at the threshold.

Every labelled document is learnt from.  Their features, a row of 16 numbers each, are dealt by
hash to blocks of about ``BLOCK`` documents that draw their pairs by themselves; a Newton step
adds up the blocks' slopes and curvatures on the driver, and the cut is found exactly by
narrowing the range of strengths that holds it.

Defined results: a null text is an empty text and has a score like any other; labels that
are null or belong to no document are not learnt from; of a document's repeated labels the
lowest counts; without both classes every score is the threshold itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tilth.llm.base import BROADCAST_ROWS, hash_of, in_tasks, rolling, segments, word_bounds
from tilth.session import staged

#: Labelled documents that draw pairs among each other, about; and the fewest of the rarer class
#: that each such block gets, if need be as copies.
BLOCK, LEAST = 8_000, 64
#: Bins of a look at the strengths, and strengths that the last look takes to the driver.
CUT_BINS, CUT_ROWS = 4_096, 20_000
#: Pairs drawn for each learning document.
PAIRS = 8
THRESHOLD = 0.7
RIDGE = 1e-2

_UPPER, _LETTER, _DIGIT, _SPACE, _LINE, _PUNCT, _MARK, _HIGH = range(8)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[65:91] = _UPPER
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[32, 9, 11, 12, 13]] = _SPACE
_KIND[10] = _LINE
_KIND[list(b".,;:'\"()-?")] = _PUNCT
_KIND[128:] = _HIGH
FEATURES = (
    "upper", "digits", "marks", "punctuation", "doubled", "log_bytes", "word_bytes", "word_spread",
    "capital_words", "marked_words", "single_marks", "repeated_words", "echo_words", "echo_gaps", "log_words", "high",
)


def features_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features for every text; all are shares or logarithms, and an empty text has zeros."""
    n = len(at) - 1
    sizes = np.diff(at)
    rows = np.repeat(np.arange(n), sizes)
    kind = _KIND[data]
    counts = np.bincount(rows * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LETTER] + counts[:, _HIGH], 1)
    seen = np.maximum(sizes - counts[:, _SPACE] - counts[:, _LINE], 1)
    twice = np.zeros(n)
    if len(data) > 1:
        same = (data[1:] == data[:-1]) & (kind[1:] >= _PUNCT) & (kind[1:] <= _MARK)
        np.add.at(twice, rows[1:][same], 1)
    starts, ends = word_bounds(data, at)
    words = hash_of(rolling(data), starts, ends)
    of = rows[starts] if len(starts) else np.zeros(0, np.int64)
    total = np.bincount(of, minlength=n).astype(float)
    many = np.maximum(total, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(of, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(of, length * length, n) / many - mean * mean, 0))
    marks = np.concatenate([[0], np.cumsum(kind == _MARK)])
    marked = (marks[ends] > marks[starts]) if len(starts) else np.zeros(0, bool)
    lone = marked & (length == 1)
    uppers = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    loud = (uppers[ends] - uppers[starts] > 1) if len(starts) else np.zeros(0, bool)
    order = np.lexsort((words, of))
    first = np.ones(len(order), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][first], minlength=n)

    def echo(gap: int) -> np.ndarray:
        if len(words) <= gap:
            return np.zeros(n)
        again = (words[gap:] == words[:-gap]) & (of[gap:] == of[:-gap])
        return np.bincount(of[gap:][again], minlength=n) / many

    share = lambda flags: np.bincount(of[flags], minlength=n) / many
    return np.column_stack([
        counts[:, _UPPER] / letters, counts[:, _DIGIT] / seen, counts[:, _MARK] / seen, counts[:, _PUNCT] / seen,
        twice / seen, np.log1p(sizes), mean / 10, spread / 10, share(loud), share(marked), share(lone),
        (many - np.maximum(distinct, 1)) / many / np.log1p(np.maximum(total, 2)), echo(1), echo(2), np.log1p(total),
        counts[:, _HIGH] / seen,
    ])


def _gaps(good: np.ndarray, bad: np.ndarray, scale: np.ndarray, pairs: int) -> np.ndarray:
    """Differences of the pairs that good and other documents draw; each is in ``pairs`` of them or more."""
    draw = np.random.default_rng(0)
    n = pairs * max(len(good), len(bad))
    return (good[draw.permutation(n) % len(good)] - bad[draw.permutation(n) % len(bad)]) / scale


def _doubts(gaps: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the logistic loss, summed over pairs."""
    doubt = 1 / (1 + np.exp(np.clip(gaps @ weights, -30, 30)))
    return gaps.T @ doubt, (gaps * (doubt * (1 - doubt))[:, None]).T @ gaps


def _weights(summed, ridge: float) -> np.ndarray:
    """Newton steps; ``summed`` gives pairs, slope and curvature at some weights."""
    weights = np.zeros(len(FEATURES))
    for _ in range(30):
        n, slope, curve = summed(weights)
        step = np.linalg.solve(curve / n + ridge * np.eye(len(weights)), slope / n - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _place(strengths: np.ndarray, good: np.ndarray, bad: np.ndarray, before: float, mass: tuple[float, float], quantile: float) -> tuple[int, bool]:
    """In ascending different strengths with their documents of both classes, the place where the mass
    reaches the quantile, and whether the next document has the same strength."""
    upto = before + np.cumsum(good * mass[1] + bad * mass[0])
    k = min(int(np.searchsorted(upto, quantile - 1e-9)), len(strengths) - 1)
    missing = quantile - 1e-9 - (upto[k - 1] if k else before)
    steps = np.cumsum(np.repeat([mass[1], mass[0]], [good[k], bad[k]]))
    return k, int(np.searchsorted(steps, missing)) < len(steps) - 1


def learn(good: np.ndarray, bad: np.ndarray, quantile: float = 0.5, pairs: int = PAIRS, ridge: float = RIDGE) -> dict:
    """Weights, cut and spread from the features of preferred and other documents.

    The cut is the strength below which a share ``quantile`` of the corpus lies, the classes
    weighed as in the corpus (``quantile`` of it is bad), whatever their numbers here.
    """
    if not len(good) or not len(bad):
        return {"weights": np.zeros(len(FEATURES)), "cut": 0.0, "spread": 1.0}
    scale = np.vstack([good, bad]).std(axis=0)
    scale[scale < 1e-9] = 1.0
    gaps = _gaps(good, bad, scale, pairs)
    weights = _weights(lambda w: (len(gaps), *_doubts(gaps, w)), ridge) / scale
    strengths = np.concatenate([good @ weights, bad @ weights])
    values, place = np.unique(strengths, return_inverse=True)
    counts = [np.bincount(part, minlength=len(values)) for part in (place[: len(good)], place[len(good) :])]
    k, again = _place(values, *counts, 0.0, (quantile / len(bad), (1 - quantile) / len(good)), quantile)
    above = values[k if again else min(k + 1, len(values) - 1)]
    return {"weights": weights, "cut": float((values[k] + above) / 2), "spread": float(max(strengths.std(), 1e-9))}


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def _features_of_rows(docs: DataFrame) -> DataFrame:
    """(id, good, f) of a table with id, good and text."""

    def work(batches):
        for batch in batches:
            for first, last, data, at in segments(batch.column(2)):
                f = features_of(data, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                     pa.array(list(f), pa.list_(pa.float64()))], ["id", "good", "f"])

    return in_tasks(docs, work, "id long, good int, f array<double>")


def _by_block(table: DataFrame, work) -> list[list[np.ndarray]]:
    """``work(features, good, copy)`` of every block, in the order of the blocks: a few hundred numbers each."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("id", "ascending")])
        f = block["f"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
        good, copy = (np.asarray(block[c]) for c in ("good", "copy"))
        order = np.lexsort((*f.T[::-1], np.asarray(block["id"])))  # ids can be repeated
        made = work(f[order], good[order] == 1, copy[order] > 0)
        return pa.table({"block": block["block"][:1], "v": pa.array([np.concatenate([np.ravel(m) for m in made]).astype(float)], pa.list_(pa.float64()))})

    found = table.groupBy("block").applyInArrow(run, "block long, v array<double>").collect()
    return [np.array(r["v"]) for r in sorted(found, key=lambda r: r["block"])]


def _in_blocks(found: DataFrame, counts: dict, blocks: int) -> DataFrame:
    """The features dealt to blocks; rows of a class that is too rare go to several, as copies."""
    home = F.pmod(F.xxhash64("id"), F.lit(blocks))
    times = {g: min(blocks, -(-LEAST * blocks // counts[g])) for g in (0, 1)}
    copies = F.sequence(F.lit(0), F.when(F.col("good") == 1, times[1]).otherwise(times[0]) - 1)
    wide = found.select("id", "good", "f", home.alias("home"), F.explode(copies).alias("copy"))
    return wide.select("id", "good", "f", "copy", F.pmod(F.col("home") + F.col("copy"), F.lit(blocks)).cast("long").alias("block"))


def _cut(strengths: DataFrame, counts: dict, quantile: float) -> float:
    """Half way between the strength at the quantile and the next one, as in ``learn``."""
    s, mass = F.col("s"), (quantile / counts[0], (1 - quantile) / counts[1])
    each = [F.count_if(F.col("good") == g) for g in (1, 0)]
    inside, before = strengths, 0.0
    while True:
        seen = inside.agg(F.min("s"), F.max("s"), F.count("*")).first()
        low, high, rows = seen
        if rows <= CUT_ROWS or low == high:
            break
        bin_ = F.least(F.floor((s - F.lit(low)) / F.lit((high - low) / CUT_BINS)), F.lit(CUT_BINS - 1)).alias("bin")
        bins = inside.groupBy(bin_).agg(each[0].alias("g"), each[1].alias("b"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        bins.sort(key=lambda r: r["bin"])
        held = np.array([[r["g"], r["b"]] for r in bins], float)
        upto = before + np.cumsum(held @ [mass[1], mass[0]])
        k = min(int(np.searchsorted(upto, quantile - 1e-9)), len(bins) - 1)
        before = float(upto[k - 1]) if k else before
        inside = inside.where(s.between(bins[k]["low"], bins[k]["high"]))
    last = sorted(inside.groupBy("s").agg(each[0].alias("g"), each[1].alias("b")).collect())
    values = np.array([r["s"] for r in last])
    k, again = _place(values, np.array([r["g"] for r in last]), np.array([r["b"] for r in last]), before, mass, quantile)
    above = None if again else strengths.where(s > float(values[k])).agg(F.min("s")).first()[0]
    return float(values[k]) if above is None else float((values[k] + above) / 2)


def _labelled(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(id, good, f) of every labelled document, written once; texts are never shuffled."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return staged(_features_of_rows(texts.join(F.broadcast(known), "id").select("id", "good", "text")), "quality")
    every = _features_of_rows(texts.select("id", F.lit(None).cast("int").alias("good"), "text")).select("id", "f")
    return staged(every.join(known, "id").select("id", "good", "f"), "quality")


def fit(docs: DataFrame, labels: DataFrame, quantile: float | None = None, key: str = "doc_id", text: str = "text",
        label: str = "quality", pairs: int = PAIRS, ridge: float = RIDGE) -> dict:
    """A model from all labelled documents, as ``learn`` makes it from arrays; up to ``BLOCK`` of them
    are one block, whose pairs are those of ``learn``.

    The threshold's quantile is, unless given, the share of bad documents among all labels
    that may be learnt from.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).cast("long").alias("id")).agg(F.min(label).cast("int").alias("good")).where("good in (0, 1)")
    )
    if quantile is None:
        shares = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
        quantile = shares.get(0, 0) / sum(shares.values()) if shares else 0.5
    found = _labelled(docs, known, key, text)
    counts = {r["good"]: r["n"] for r in found.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return {"weights": np.zeros(len(FEATURES)), "cut": 0.0, "spread": 1.0}
    n = sum(counts.values())
    if n <= BLOCK:  # one block, whose passes are not worth a job each
        rows = sorted((r["id"], r["good"], r["f"]) for r in found.collect())
        f, good = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows], int)
        return learn(f[good == 1], f[good == 0], quantile, pairs, ridge)
    table = staged(_in_blocks(found, counts, -(-n // BLOCK)), "quality-blocks")
    mean = sum(_by_block(table, lambda f, good, copy: [f[~copy].sum(axis=0)])) / n
    scale = np.sqrt(sum(_by_block(table, lambda f, good, copy: [((f[~copy] - mean) ** 2).sum(axis=0)])) / n)
    scale[scale < 1e-9] = 1.0
    many = len(FEATURES)

    def summed(weights):
        def work(f, good, copy):
            if good.all() or not good.any():
                return [np.zeros(1 + many + many * many)]
            gaps = _gaps(f[good], f[~good], scale, pairs)
            return [[len(gaps)], *_doubts(gaps, weights)]

        v = sum(_by_block(table, work))
        return v[0], v[1 : 1 + many], v[1 + many :].reshape(many, many)

    weights = _weights(summed, ridge) / scale
    strength = F.lit(0.0)
    for i, w in enumerate(weights.tolist()):
        strength = strength + F.lit(w) * F.col("f")[i]
    middle = float(mean @ weights)
    spread = float(np.sqrt(sum(_by_block(table, lambda f, good, copy: [[((f[~copy] @ weights - middle) ** 2).sum()]]))[0] / n))
    return {"weights": weights, "cut": _cut(found.select("good", strength.alias("s")), counts, quantile), "spread": max(spread, 1e-9)}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text: str = "text", carry: list[str] | None = None,
          name: str = "score") -> DataFrame:
    """The columns ``carry`` of ``docs`` (default all) with ``name``: the strength on a logistic
    scale that has ``threshold`` at the cut."""
    kept = [c for c in (docs.columns if carry is None else carry) if c != name]
    weights, cut, spread = model["weights"], model["cut"], model["spread"]
    lift = float(np.log(threshold / (1 - threshold)))
    schema = docs.select(*kept).schema.add(name, "double")

    def work(batches):
        for batch in batches:
            body = batch.column(0).fill_null("")
            done = [features_of(data, at) @ weights for _, _, data, at in segments(body)]
            strength = np.concatenate(done) if done else np.zeros(0)
            value = 1 / (1 + np.exp(-np.clip(4 * (strength - cut) / spread + lift, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(value)], [*kept, name])

    return in_tasks(docs.select(F.col(text).alias("__text"), *kept), work, schema)
