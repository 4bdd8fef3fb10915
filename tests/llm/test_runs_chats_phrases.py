"""Periodic runs, chat windows and collocations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tilth.llm import catalog, chat, collocations, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---- periodic runs


def plain_runs(w, least=6, repeats=4):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looping_texts(seed, n):
    draw = random.Random(seed)
    for _ in range(n):
        vocabulary = [f"w{k}é" for k in range(draw.choice((1, 2, 3, 40)))]
        words = []
        for _ in range(draw.randint(0, 5)):
            unit = draw.choices(vocabulary, k=draw.randint(1, 70))
            words += [unit[i % len(unit)] for i in range(draw.choice((len(unit), draw.randint(1, 6 * len(unit)))))]
        yield draw.choice((" ", "\n", " \t ")).join(words)


def test_runs_equal_a_plain_search(documents):
    texts = list(looping_texts(3, 400))
    rows = periodic.periodic_runs(documents([(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = WORD.findall(texts[r.doc_id])
        want = plain_runs(words)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
        assert r.collapsed == kept_words(words, want)


def test_long_periods_and_long_texts(documents):
    draw = random.Random(5)
    unit = [f"x{draw.randrange(10**6)}" for _ in range(3001)]
    text = " ".join(["before"] + unit * 5 + unit[:17] + ["after"] * 9)
    (row,) = periodic.periodic_runs(documents([(1, text, "a")])).collect()
    assert [tuple(x) for x in row.runs] == [(1, 5 * 3001 + 17, 3001), (1 + 5 * 3001 + 17, 9, 1)]
    assert row.collapsed == " ".join(["before"] + unit + ["after"])


def test_runs_of_odd_documents(odd_documents, documents):
    rows = periodic.periodic_runs(odd_documents, carry=("doc_id", "n_chars", "score")).collect()
    assert len(rows) == odd_documents.count() and all(r.score == "x" for r in rows)
    assert all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in rows if r.n_chars is None)
    assert periodic.periodic_runs(documents([])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd_documents, repeats=3)


def test_query_of_runs_equals_a_plain_one(spark, tmp_path, documents):
    texts = [*looping_texts(4, 60), None, "", " "]
    docs = documents([(i * 7 - 30, t, "a") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in catalog.periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for i, text in enumerate(texts):
        doc = i * 7 - 30
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            looped += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = found[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept_words(w, runs).encode()).hexdigest()
    assert looped and len(found) == len(texts)


# ---- chat windows

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[AS]", "[/ROLE]", "\\", "<\\s>", "[\\INST]", " ", "\n", "é😀", "word "]


def turns_table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, tokens long, block long")


def chats(seed, n, most=30):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, most)):
            role = "system" if t == 0 and draw.random() < 0.5 else draw.choice(("user", "assistant", "assistant", "tool", None, "system", "a]b"))
            text = draw.choice((None, "", "".join(draw.choices(MARKS, k=draw.randint(1, 40)))))
            rows.append((c, t, role, text, "x", 1, 2))
    draw.shuffle(rows)
    return rows


def in_order(rows):
    out = defaultdict(list)
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        out[c].append((role, text or ""))
    return out


def check_windows(rows, windows, budget, history):
    """Windows own every turn once, in order, within the budget, and repeat what they should."""
    by = defaultdict(list)
    for w in windows:
        by[w.conv_id].append(w)
    want = in_order(rows)
    assert set(by) == set(want)
    sizes = chat.encoder(BPE)
    for c, turns in want.items():
        at = 0
        cost = [len(sizes.model.encode(chat.rendered(*t), add_special_tokens=False).ids) for t in turns]
        has_system = turns[0][0] == "system"
        for w in sorted(by[c], key=lambda w: w.first_turn):
            shown = list(chat.parsed(w.text))
            assert w.first_turn == at and shown[w.repeated:] == turns[at : at + w.n_turns]
            front = 1 if has_system and at > 0 else 0
            assert shown[:front] == turns[:front]
            back = w.repeated - front
            assert shown[front : w.repeated] == turns[at - back : at]
            low = 1 if has_system else 0
            assert sum(cost[at - back : at]) <= history
            if at - back > low:  # one more turn of history would be too much
                assert sum(cost[at - back - 1 : at]) > history
            assert w.tokens == sum(cost[:front]) + sum(cost[at - back : at + w.n_turns])
            assert w.tokens <= budget or w.n_turns == 1
            end = at + w.n_turns
            said = [chat.unescaped(w.text[s.start : s.end]) for s in w.loss]
            assert said == [t for r, t in turns[at:end] if r == "assistant"]
            at = end
        assert at == len(turns)


def test_windows_own_every_turn_once(spark):
    rows = chats(1, 60)
    check_windows(rows, chat.format_chats(turns_table(spark, rows), BPE, 120, 40).collect(), 120, 40)


def test_a_conversation_over_many_blocks_and_partitions(spark):
    draw = random.Random(2)
    rows = chats(3, 4) + [(9, t, "system" if t == 0 else draw.choice(("user", "assistant")), f"turn {t} " * draw.choice((1, 3, 60)), "x", 1, 2)
                          for t in range(3000)]
    windows = chat.format_chats(turns_table(spark, rows).repartition(3), BPE, 100, 30).collect()
    check_windows(rows, windows, 100, 30)
    assert len({w.first_turn for w in windows if w.conv_id == 9}) > 64


def test_marks_in_texts_come_back():
    draw = random.Random(4)
    for _ in range(2000):
        turns = [(draw.choice(("user", "assistant", "system", "tool", "", None, "[AS] x")), "".join(draw.choices(MARKS, k=draw.randint(0, 6))))
                 for _ in range(draw.randint(1, 4))]
        assert list(chat.parsed("".join(chat.rendered(*t) for t in turns))) == turns
        assert not any(chat._MARK.search(chat.escaped(t)) for _, t in turns)


def test_chats_with_nulls_ties_and_no_rows(spark):
    rows = [(None, None, None, None, None, None, None), (None, 1, "user", "a", None, None, None), (1, 0, "user", "b", "x", 1, 1),
            (1, 0, "user", "b", "x", 1, 1), (1, 0, "assistant", "c", "x", 1, 1), (2, None, "assistant", "long " * 5000, "x", 1, 1)]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns_table(spark, rows), BPE)).collect()}
    assert {k: r.n_turns for k, r in back.items()} == {None: 2, 1: 3, 2: 1}
    assert back[None].turns_sha256 == hashlib.sha256(b"user\na\n\n\n").hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256(b"assistant\nc\nuser\nb\nuser\nb\n").hexdigest()
    assert back[2].loss_chars == 25000
    assert chat.read_back(chat.format_chats(turns_table(spark, []), BPE)).collect() == []


def test_query_of_chats_reads_back_what_went_in(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = in_order([tuple(r) for r in table])
    want[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    rows = catalog.chat_windows(spark, sf_dir).collect()
    assert sorted(r.conv_id for r in rows) == sorted(want)
    for r in rows:
        turns = want[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said) and r.formatted_chars >= sum(len(t) for _, t in turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# ---- collocations


def plain_collocations(rows, limit, least, share):
    out = []
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3, 4):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * most[p] >= share * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def phrase_rows(seed, n):
    draw = random.Random(seed)
    vocabulary = {lang: [f"{lang}{k}" for k in range(40)] + ["É", "of", "New", "york"] for lang in ("a", "b", "c")}
    fixed = {lang: [draw.choices(words, k=draw.randint(2, 6)) for _ in range(12)] for lang, words in vocabulary.items()}
    for _ in range(n):
        lang = draw.choice("aaab") if draw.random() < 0.95 else draw.choice(("c", None))
        words = []
        for _ in range(draw.randint(0, 12)):
            words += draw.choice(fixed[lang or "c"]) if draw.random() < 0.5 else draw.choices(vocabulary[lang or "c"], k=3)
            words.append(draw.choice((".", ",", "\n", "", "", "\t", "!")))
        yield lang, " ".join(words)


def phrase_table(documents, rows):
    return documents([(i, t, "s") for i, (_, t) in enumerate(rows)], extra=("phrase", "f", "width", "a")).drop("lang").join(
        documents([(0, "", "s")]).sparkSession.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string"), "doc_id")


def found_collocations(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize("limit,least,share,seed", [(5, 3, 80, 1), (25, 5, 80, 2), (2000, 2, 60, 3)])
def test_phrases_equal_a_full_count(documents, limit, least, share, seed):
    rows = list(phrase_rows(seed, 300))
    assert found_collocations(phrase_table(documents, rows), limit=limit, least=least, share=share) == plain_collocations(rows, limit, least, share)


def test_a_frontier_too_large_to_send(documents, monkeypatch):
    rows = list(phrase_rows(4, 120))
    monkeypatch.setattr(collocations, "FRONTIER_ROWS", 3)
    assert found_collocations(phrase_table(documents, rows), limit=8, least=3) == plain_collocations(rows, 8, 3, 80)


def test_more_rounds_when_few_survive(documents, monkeypatch):
    rows = list(phrase_rows(5, 300))
    monkeypatch.setattr(collocations, "GROWTH", 2)
    monkeypatch.setattr(collocations, "START", 1)
    assert found_collocations(phrase_table(documents, rows), limit=12, least=3) == plain_collocations(rows, 12, 3, 80)


def test_phrases_of_odd_documents(odd_documents, documents):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    assert found_collocations(odd_documents, least=2) == plain_collocations(rows, 2000, 2, 80)
    assert found_collocations(documents([])) == [] and found_collocations(documents([(1, None, "a"), (2, ".", "a")])) == []
