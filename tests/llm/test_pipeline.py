"""The whole pipeline against its stages written plainly in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from test_documents import PIECES, WORD, corpus, near, shares

import corpus_pipeline
from tilth.llm import quality


def features(text):
    raw = (text or "").encode()
    kinds = ["U" if 65 <= c <= 90 else "l" if 97 <= c <= 122 else "d" if 48 <= c <= 57 else "s" if c in b" \t\n\v\f\r" else "h" if c >= 128
             else "p" if c in b".,;:'\"()-?" else "m" for c in raw]
    n = Counter(kinds)
    letters, seen = max(n["U"] + n["l"] + n["h"], 1), max(len(raw) - n["s"], 1)
    words = re.findall(rb"[^ \t-\r]+", raw)
    kind = lambda w, k: sum({"m": c < 128 and not chr(c).isalnum() and c not in b".,;:'\"()-?", "U": 65 <= c <= 90}[k] for c in w)
    many, sizes = max(len(words), 1), [len(w) for w in words]
    mean = sum(sizes) / many
    marked = [kind(w, "m") > 0 for w in words]
    echo = lambda gap: sum(a == b for a, b in zip(words, words[gap:])) / many
    return [
        n["U"] / letters, n["d"] / seen, n["m"] / seen, n["p"] / seen,
        sum(a == b and k in "pm" for a, b, k in zip(raw, raw[1:], kinds[1:])) / seen, math.log1p(len(raw)), mean / 10,
        math.sqrt(max(sum(x * x for x in sizes) / many - mean * mean, 0)) / 10, sum(kind(w, "U") > 1 for w in words) / many,
        sum(marked) / many, sum(m and len(w) == 1 for m, w in zip(marked, words)) / many,
        (many - max(len(set(words)), 1)) / many / math.log1p(max(len(words), 2)), echo(1), echo(2), math.log1p(len(words)), n["h"] / seen,
    ]


def judge(docs, labels):
    """The learning of weights from features is that of the library."""
    known = {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    found = {i: np.array(features(t)) for i, t, _ in docs}
    good, bad = ([found[i] for i in sorted(known) if known[i] == q] for q in (1, 0))
    model = quality.learn(np.array(good), np.array(bad), len(bad) / len(known))
    return [d for d in docs if found[d[0]] @ model["weights"] >= model["cut"]]


def one_of_each(docs):
    _, parts = near([t for _, t, _ in docs], 5, 80)
    return [d for k, d in enumerate(docs) if parts[k] == k]


def strip(docs, length=100):
    seen, out = set(), []
    for i, t, s in docs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for at in range(len(raw) - length + 1):
            if raw[at : at + length] in seen:
                gone[at : at + length] = [True] * length
            seen.add(raw[at : at + length])
        left = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore") if any(gone) else t
        if left or not any(gone):
            out.append((i, left, s))
    return out


def mix(docs):
    rows, out = defaultdict(list), []
    for i, t, s in docs:
        rows[s].append((len(WORD.findall(t or "")), i, t))
    sizes = {s: sum(n for n, *_ in x) for s, x in rows.items()}
    wanted = shares(sizes)
    for s, x in rows.items():
        x.sort(key=lambda r: r[:2])
        share = wanted[s] / sizes[s]
        first = int(hashlib.md5(b"0/" + (b"" if s is None else b"=" + s.encode())).hexdigest()[:6], 16) / (1 << 24)
        tries = []
        for j in range(64):
            u = (first + j / 64) % 1.0
            copies = [min(math.floor((p + 1) * share + u) - math.floor(p * share + u), 3) for p in range(len(x))]
            tries.append((abs(sum(c * r[0] for c, r in zip(copies, x)) - wanted[s]), j, copies))
        for c, (_, i, t) in zip(min(tries)[2], x):
            out += [(i, t, s)] * c
    return out


def test_pipeline_equals_plain_stages(spark, documents, tmp_path):
    draw = random.Random(11)
    texts = [f"T{t}" for t in corpus(9, 130) if t]
    for k in range(40):  # near copies, just above and below the bound
        words = texts[draw.randrange(len(texts))].split()
        for _ in range(draw.choice([1, 1, 2, 5])):
            words[draw.randrange(1, max(2, len(words))) % len(words)] = f"new{k}"
        texts.append(" ".join(words))
    passage = "A passage of more than a hundred bytes, été, that stands in several documents of the corpus and in each of them once. "
    texts += [f"Start {k} of its own {k * k} " + passage + f"end of number {k} " * 9 for k in range(12)]
    texts += [passage, "x", "Été"]
    good = len(texts)
    texts += [f"J{k} " + " ".join("".join(draw.choices("#$%&*+=@^_~|<>019XZ", k=draw.randint(1, 9))) for _ in range(draw.randint(20, 60))) for k in range(70)]
    order = list(range(len(texts)))
    draw.shuffle(order)
    docs = [(i, texts[k], draw.choices(["a", "b", "c", "é", None], [50, 25, 5, 15, 5])[0]) for i, k in enumerate(order)]
    labels = {i: int(order[i] < good) for i in range(len(docs)) if draw.random() < 0.8}
    documents(docs).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    judged = judge(docs, labels)
    ones = one_of_each(judged)
    stripped = strip(ones)
    mixed = mix(stripped)
    assert len(docs) > len(judged) > len(ones) >= len(stripped) and {t for _, t, _ in ones} != {t for _, t, _ in stripped}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t, s in mixed:
        ids = library.encode(t or "")
        want.append((i, str(s), ids, len(ids), library.decode(ids) == (t or "")))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, str(r.source), list(r.ids), r.n_pieces, r.exact) for r in rows)
    assert {r[0] for r in got} == {r[0] for r in want}
    assert got == sorted(want)
