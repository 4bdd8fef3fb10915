"""Operators on documents against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tilth.llm import minhash, mixing, pieces, quality, repeats, shards, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed=0, n=120):
    """Texts with exact and near copies, shared passages and repeats inside a text."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzéß", k=draw.randint(1, 9))) for _ in range(400)]
    passage = " ".join(draw.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        words = draw.choices(vocabulary, k=draw.choice((1, 2, 5, 40, 120)))
        if i % 5 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 7 == 2 and texts:
            words = draw.choice(texts).split(" ")
            for _ in range(len(words) // 25):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        text = " ".join(words)
        if i % 11 == 3 and texts:
            text = draw.choice(texts)
        if i % 13 == 4:
            text = text + "\n" + text
        texts.append(text)
    return [*texts, "", "ab" * 400, "ab" * 90 + "c"]


# ---- sharding


def test_shards_are_near_equal_and_slots_gapless(documents):
    texts = corpus(1, 600)
    docs = documents([(i, t, "a") for i, t in enumerate(texts)])
    rows = shards.shard(docs, 4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    loads = defaultdict(int)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        loads[r.shard] += r.size
    assert set(loads) == set(range(4)) and max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 4
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = {r.doc_id: (r.shard, r.slot) for r in shards.shard(docs.repartition(7), 4).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_versions_of_the_map(spark, documents, tmp_path):
    totals = spark.createDataFrame([(i, 100 + i % 7) for i in range(64)], "slot int, bytes long")
    first = shards.balanced_map(totals, 4)
    path = str(tmp_path / "map")
    shards.store_map(first, path)
    shards.store_map(shards.grown_map(shards.read_map(spark, path), 4), path)
    old = {r.slot: r.shard for r in shards.read_map(spark, path, 1).collect()}
    new = {r.slot: r.shard for r in shards.read_map(spark, path).collect()}
    moved = {s for s in old if old[s] != new[s]}
    assert set(old) == set(new) == set(range(64)) and moved and {new[s] for s in moved} == {4}
    assert 0.5 < sum(100 + s % 7 for s in moved) / (sum(100 + i % 7 for i in range(64)) / 5) <= 1.01


def test_a_stored_map_is_edited(spark, documents, tmp_path):
    path = str(tmp_path / "map")
    texts = corpus(1, 600)

    def run(texts, n):
        rows = shards.shard(documents([(i, t, "a") for i, t in enumerate(texts)]), n, map_path=path).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        loads = [sum(r.size for r in rows if r.shard == s) for s in range(n)]
        assert max(loads) - min(loads) <= shards.read_map(spark, path).agg(F.max("bytes")).first()[0]
        for s in range(n):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        return {r.virtual_slot: (r.shard, r.map_version) for r in rows}

    first = run(texts, 4)
    assert run(texts, 4) == first and {v for _, v in first.values()} == {1}
    more = run(texts, 5)
    to = [more[s][0] for s in more if more[s][0] != first[s][0]]
    assert {v for _, v in more.values()} == {2} and len(to) < 0.3 * len(more) and to.count(4) > 0.5 * len(to)
    lighter = run([t if first[s][0] else t[:40] for s, t in zip(_slots(spark, texts), texts)], 5)
    assert {v for _, v in lighter.values()} == {3}
    assert 0 < sum(lighter[s][0] != more[s][0] for s in more) < 0.5 * len(more)
    fewer = run(texts, 3)
    assert {x for x, _ in fewer.values()} == {0, 1, 2} and {v for _, v in fewer.values()} == {4}


def _slots(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.s for r in rows.select("doc_id", shards.slot_of("doc_id", "text").alias("s")).orderBy("doc_id").collect()]


# ---- mixing


def shares(sizes, weights=(5, 2, 1)):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_its_targets(documents, seed):
    draw = random.Random(seed)
    texts = [" ".join("w" * draw.randint(1, 40)) for _ in range(900)]
    sources = [draw.choices(["a", "b", "c", "d", "é", None], [60, 20, 1, 10, 8, 1])[0] for _ in texts]
    docs = documents([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))])
    rows = mixing.plan(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(WORD.findall(t))
    wanted = shares(dict(sizes))
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id])) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)
    copies = defaultdict(int)
    for r in mixing.mix(docs).select("doc_id").collect():
        copies[r.doc_id] += 1
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}
    again = mixing.plan(docs.repartition(5)).select("row.doc_id", "copies").collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in rows}


# ---- near-duplicates


def near(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_the_exact_components(documents, width):
    texts = [t.upper() if i % 17 == 0 else t for i, t in enumerate(corpus(2, 260))]
    sizes, parts = near(texts, width, 80)
    got = minhash.near_duplicates(documents([(i, t, "a") for i, t in enumerate(texts)]), width, 80).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], parts[i]) for i in range(len(texts))}
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_large_group_of_near_copies_is_one_component(documents):
    draw = random.Random(5)
    base = [f"w{draw.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        words[draw.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(words), "a"))
    rows += [(300 + i, base[0] + " " + base[1] + f" q{i} r{i} s{i} t{i}", "b") for i in range(200)]
    sizes, parts = near([r[1] for r in rows], 2, 80)
    got = {r.id: r.component_id for r in minhash.near_duplicates(documents(rows), 2, 80).collect()}
    assert got == dict(enumerate(parts)) and len(set(parts)) == 201


# ---- repeats


def without_repeats(texts, length=100):
    """(bytes, removed, runs, digest) of each text."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            head = raw[i : i + length]
            if head in seen:
                gone[i : i + length] = True
            seen.add(head)
        runs = int(np.sum(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [0, 4])
def test_repeats_are_removed_exactly(spark, documents, monkeypatch, most):
    texts = corpus(3, 200)
    monkeypatch.setattr(repeats, "SEGMENT", 2000)
    wanted = without_repeats(texts)
    docs = documents([(i, t, "a") for i, t in enumerate(texts)]).repartition(5)
    keyed = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = {r.key: [(s.lo, s.hi) for s in r.spans] for r in repeats.repeated_spans(keyed, most=most).collect()}
    assert {i: (n, k) for i, (_, n, k, _) in enumerate(wanted) if n} == {i: (sum(b - a for a, b in x), len(x)) for i, x in spans.items()}
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs, digest=True).collect()}
    assert got == dict(enumerate(wanted))


def test_stripped_texts_are_valid_and_empty_ones_go(documents):
    line = "été à la plage, " * 20
    docs = documents([(1, "start " + line, "a"), (2, "é" + line, "a"), (3, line, "a"), (4, "", "a"), (5, "plain", "b")])
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.stripped(docs).collect()}
    assert set(got) == {1, 2, 4, 5} and got[5] == ("plain", 5) and got[4][0] == ""
    assert got[1][0].startswith("start été") and len(got[1][0]) == got[1][1] < len("start " + line)


# ---- token sequences


def test_sequences_hold_every_id_in_order(spark, documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    texts = [*corpus(4, 90), None, "  two  spaces ", "  nbsp em ", "a\n\n b", "<|endoftext|> a <|endoftext|>", "it's 12 o'clock\x85 x\x1c y",
             "日本 語", " lead", "trail ", "\x00 zero"]
    docs = documents([(i, t, "a") for i, t in enumerate(texts)]).repartition(6)
    manifest = tokens.write_sequences(docs, BPE, length=16, rows=4)
    got = {r.id: r for r in tokens.read_documents(spark, manifest).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), t
        at += len(ids)
    for r in manifest.collect():
        held = tokens.Sequences(r.file)
        count = sum(held.file.get_batch(b).num_rows for b in range(held.batches))
        masks = [held.sequence(k)[1] for k in range(count)]
        assert all(len(m) == 16 for m in masks) and sum(int(m.sum()) for m in masks) == r.tokens
        assert all(m.all() for m in masks[:-1])
        ids, _ = held.sequence(0)
        assert not ids.flags.owndata  # a view of the file


# ---- pieces


@pytest.mark.parametrize("kind", ["bpe"])
def test_pieces_are_those_of_the_library(spark, documents, kind):
    import sentencepiece

    texts = [*corpus(6, 60), None, "  a  b ", "\n\n x", "▁a▁", "日本語 한국어 😀", "a" * 300, "\t\x00 é", "x" * 60 + " " + "é1" * 40, "ends \n"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode(documents([(i, t, "a") for i, t in enumerate(texts)]), PIECES, carry=["doc_id"])
    got = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t or ""), t
        assert got[i].n_pieces == len(got[i].ids) and got[i].exact == (library.decode(got[i].ids) == (t or ""))
    back = {r.doc_id: r.text for r in pieces.decode(encoded.select("doc_id", "ids"), PIECES).collect()}
    assert all(back[i] == library.decode(list(got[i].ids)) for i in got)


def test_cheapest_path_of_a_weighted_lattice():
    """With weights the path is that of the least sum, here against all segmentations."""
    machine = pieces.Transducer(PIECES)
    machine.kind = pieces.UNIGRAM
    draw = random.Random(0)
    machine.weight = np.array([draw.random() * 5 for _ in machine.weight])

    def best(word):
        if not word:
            return 0.0
        parts = [(machine.weight[machine.by_name[word[:k]]], k) for k in range(1, len(word) + 1) if word[:k] in machine.by_name]
        return min((w + best(word[k:]) for w, k in parts), default=float("inf"))

    words = ["▁the", "▁hello", "ation", "▁under"]
    for word, ids in zip(words, machine.solve(words)):
        path = np.frombuffer(ids, "<i4")
        assert "".join(machine.names[i] for i in path) == word
        assert machine.weight[path].sum() == pytest.approx(best(word))
        assert machine.weight[machine._solve_long(word)].sum() == pytest.approx(best(word))


# ---- quality


def test_quality_on_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model, carry=["doc_id"]).join(labels, "doc_id")
    held = scored.where(quality.held_out()).select("score", "quality").collect()
    assert held and sum((r.score >= 0.7) == (r.quality == 1) for r in held) >= 0.95 * len(held)
    # weights come from other labels alone
    spoiled = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, spoiled)["weights"], model["weights"])


def test_pairwise_weights_order_documents():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0, 1, (200, len(quality.FEATURES))), draw.normal(0, 1, (50, len(quality.FEATURES)))
    good[:, 3] += 3
    model = quality.learn(good, bad, 0.2)
    assert np.argmax(np.abs(model["weights"])) == 3
    assert 0.1 < np.mean(good @ model["weights"] < model["cut"]) * 0.8 + np.mean(bad @ model["weights"] < model["cut"]) * 0.2 < 0.3


def test_every_labelled_document_is_learnt_from(spark, sf_dir, monkeypatch):
    """One block equals the arrays, many blocks nearly so, rare classes included; and the cut is exact."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(~quality.held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("good"))
    rows = quality._labelled(docs, known, "doc_id", "text").collect()
    rows.sort(key=lambda r: (r["id"], r["f"]))
    f, good = np.array([r["f"] for r in rows]), np.array([r["good"] for r in rows])
    want = quality.learn(f[good == 1], f[good == 0], known.where("good = 0").count() / known.count())
    whole = quality.fit(docs, labels)
    assert all(np.allclose(whole[k], want[k], rtol=1e-9) for k in want)
    seen = []
    monkeypatch.setattr(quality, "BLOCK", max(2, len(rows) // 6))
    monkeypatch.setattr(quality, "LEAST", 5)
    monkeypatch.setattr(quality, "CUT_ROWS", 3)
    by_block = quality._by_block
    monkeypatch.setattr(quality, "_by_block", lambda table, work: seen.append(table) or by_block(table, work))
    parts = quality.fit(docs, labels)
    assert seen[0].where("copy = 0").count() == len(rows) and seen[0].select("block").distinct().count() >= 6
    assert seen[0].groupBy("block").agg(F.count_if(F.col("good") == 0).alias("b"), F.count_if(F.col("good") == 1).alias("g")).where("b = 0 or g = 0").isEmpty()
    s, t = f @ parts["weights"], f @ want["weights"]
    assert np.corrcoef(s, t)[0, 1] > 0.97
    order = np.sort(s)
    share = known.where("good = 0").count() / known.count()
    mass = np.where(good == 1, (1 - share) / (good == 1).sum(), share / (good == 0).sum())
    k = int(np.searchsorted(np.cumsum(mass[np.argsort(s, kind="stable")]), share - 1e-9))
    assert parts["cut"] == pytest.approx((order[k] + order[k + 1]) / 2, rel=1e-9, abs=1e-9)
    assert parts["spread"] == pytest.approx(s.std(), rel=1e-9)


# ---- odd tables


def run_all(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, None, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    made = {
        "shards": shards.shard(docs, 4), "mix plan": mixing.plan(docs), "mix": mixing.mix(docs),
        "near": minhash.near_duplicates(docs, 2, 80), "one": minhash.keep_one(docs),
        "repeats": repeats.without_repeats(docs), "stripped": repeats.stripped(docs),
        "tokens": tokens.read_documents(spark, tokens.write_sequences(docs, BPE)),
        "pieces": pieces.encode(docs, PIECES, carry=["doc_id"]), "score": quality.score(docs, model),
    }
    return {name: df.collect() for name, df in made.items()}


def test_odd_rows(spark, odd_documents):
    got = run_all(spark, odd_documents)
    n = odd_documents.count()
    assert all(len(got[x]) == n for x in ("shards", "mix plan", "near", "repeats", "tokens", "pieces", "score"))
    assert all(0 <= r.score <= 1 for r in got["score"])
    one = {(r.doc_id, (r.text or "")[:20]) for r in got["one"]}
    assert len(got["one"]) == n - 2 and (6, "word0 and0 word1 and") not in one
    copies = [r for r in got["repeats"] if r.id == 6]
    assert copies[0].n_removed > 0.9 * copies[0].n_bytes
    assert got["stripped"][0].asDict().keys() == got["one"][0].asDict().keys() == set(odd_documents.columns)
    assert sum(r.n_tokens for r in got["tokens"] if r.id is None) > 1


def test_empty_tables(spark, documents):
    got = run_all(spark, documents([]))
    assert all(rows == [] for rows in got.values())


def test_long_words_have_the_ids_of_the_library(documents):
    from sentencepiece import SentencePieceProcessor

    draw = random.Random(9)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/=", k=30_000)), "".join(chr(draw.randint(0x4E00, 0x9FA0)) for _ in range(10_000)),
             "the" * 5_000, "".join(draw.choices("日本語のテキスト中文éñ", k=5_000)) + " " + "x" * 3_000]
    want = SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)
    found = {r.doc_id: r for r in pieces.encode(documents([(i, t, "a") for i, t in enumerate(texts)]), PIECES, carry=["doc_id"]).collect()}
    assert all(list(found[i].ids) == want[i] and found[i].exact for i in range(len(texts)))
