"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` turns a model file into tables: the normaliser (escape of spaces, dummy
prefix, collapsing of spaces), the pieces as arcs that read their characters, and byte
fallback as arcs for characters that are no piece.  Composed with an input, the machine is a
lattice of places; its states are (place, last piece).  Arcs are weighed in the tropical
semiring and the cheapest path is taken place by place.

* Unigram models: an arc weighs the negative score of its piece.
* BPE models: the encoding is the one path whose neighbouring pieces would not have been
  merged otherwise, so an arc weighs 0 after a piece it can stand beside and infinity after
  any other.  Two pieces can stand side by side if merging their joint characters gives
  just them; such pairs are found by merging once and remembered.

Either way the best path to a place has one last piece, so one number per place is kept and
many words are solved at a time, position by position.  No piece crosses from another
character to a space, and none holds a line feed, so texts are cut there and each different
word is solved once while it is remembered.

Defined results: null and empty texts have no pieces; equal texts have equal pieces; ids
below 0 or outside the model are refused by ``decode``.  The escape character itself reads
as a space, so a text that holds it does not come back unchanged (column ``exact``).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tilth.llm.base import INVERSES, POWERS, in_tasks, kept, mixed, segments

SPACE = "▁"
#: Words longer than this are solved one by one.
LONG = 48
#: Bytes of text encoded together.
RUN_BYTES = 1 << 21
#: Words a transducer remembers; those that come later are solved wherever they turn up.
REMEMBERED = 200_000
_SLOTS = 21  # bits of the table of pairs
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class _Table:
    """Numbers to small numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(len(keys)).bit_length() + 3, 8)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.tries = 1
        waiting = np.arange(len(keys))
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        mask = (1 << self.bits) - 1
        while len(waiting):
            free = self.values[slot[waiting]] < 0
            first = np.unique(slot[waiting][free], return_index=True)[1]
            put = waiting[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            waiting = np.setdiff1d(waiting, put)
            slot[waiting] = (slot[waiting] + 1) & mask
            self.tries += len(waiting) > 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where(self.keys[slot] == keys, self.values[slot], -1)
        for _ in range(self.tries - 1):
            missing = np.flatnonzero((found < 0) & (self.values[slot] >= 0))
            if not len(missing):
                break
            slot[missing] = (slot[missing] + 1) & mask
            at = slot[missing]
            found[missing] = np.where(self.keys[at] == keys[missing], self.values[at], -1)
        return found


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((matrix.shape[0], matrix.shape[1] + 1), np.uint64)
    np.cumsum((matrix.astype(np.uint64) + np.uint64(1)) * POWERS.upto(matrix.shape[1]), axis=1, out=out[:, 1:])
    return out


def _part(prefix: np.ndarray, start: int, end: int) -> np.ndarray:
    return mixed((prefix[:, end] - prefix[:, start]) * INVERSES.upto(start + 1)[start])


class Transducer:
    """A compiled model; ``encode`` gives ids as int32 bytes, ``decode`` texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("models with a character map are not compiled")
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is no path problem")
        self.dummy, self.collapse = model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces
        self.names = [p.piece for p in model.pieces]
        types = np.array([p.type for p in model.pieces])
        scores = np.array([p.score for p in model.pieces], float)
        self.unknown = int(np.flatnonzero(types == UNKNOWN)[0])
        self.bytes = {int(self.names[i][3:5], 16): int(i) for i in np.flatnonzero(types == BYTE)}
        normal = [int(i) for i in np.flatnonzero(np.isin(types, (NORMAL, USER, UNUSED)))]
        if any("\n" in self.names[i] or SPACE in self.names[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a line feed, or a space after another character")
        self.other = len(self.names)  # stands for a character that is no piece
        self.weight = np.append(-scores, 10.0 - min(scores[normal], default=0.0))
        order = np.argsort(-scores, kind="stable")
        self.rank = np.zeros(len(scores), np.int64)
        self.rank[order] = np.arange(len(scores))
        self.by_name = {self.names[i]: i for i in normal}
        self.longest = max(map(len, self.by_name), default=1)
        hashes = []
        for i in normal:
            points = _points([self.names[i]])[None, :]
            hashes.append(_part(_prefix(points), 0, points.shape[1])[0])
        self.lookup = _Table(np.array(hashes, np.uint64), np.array(normal, np.int32))
        split, into = [], []
        if self.kind == BPE:
            for name, i in self.by_name.items():
                for cut in range(1, len(name)):
                    a, b = self.by_name.get(name[:cut]), self.by_name.get(name[cut:])
                    if a is not None and b is not None:
                        split.append(self._pair(a, b))
                        into.append(i)
        self.merges = _Table(mixed(np.array(split, np.uint64)), np.array(into, np.int32))
        self.merge_of = dict(zip(split, into))
        width = self.longest
        self.chars = np.full((self.other + 1, width), -1, np.int32)  # each piece as single characters
        for i in normal:
            self.chars[i, : len(self.names[i])] = [self.by_name.get(c, self.other) for c in self.names[i]]
        self.chars[self.other, 0] = self.other
        self.pairs = np.zeros(1 << _SLOTS, np.uint64)  # remembered pairs: key * 2 + whether they can stand together, + 1
        self.remembered = remembered
        self.beside: dict[int, bool] = {}
        self.ranks = self.rank.tolist()
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.surface = [self._surface(i, types[i]) for i in range(len(self.names))]

    def _pair(self, a, b):
        return a * (self.other + 1) + b

    def _surface(self, i: int, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return self.names[i].replace(SPACE, " ").encode()

    # -- which pieces can stand side by side ----------------------------------------------

    def _merged_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b, best piece first, leftmost first, gives a and b."""
        sizes = [(self.chars[x] >= 0).sum(axis=1) for x in (a, b)]
        width = int((sizes[0] + sizes[1]).max(initial=1))
        n = len(a)
        now = np.full((n, width), -1, np.int64)
        for x, size, start in ((a, sizes[0], np.zeros(n, int)), (b, sizes[1], sizes[0])):
            for j in range(int(size.max(initial=0))):
                live = np.flatnonzero(size > j)
                now[live, start[live] + j] = self.chars[x[live], j]
        live = np.arange(n)
        worst = np.iinfo(np.int64).max
        while len(live) and width > 1:
            left, right = now[live, :-1], now[live, 1:]
            known = (left >= 0) & (right >= 0)
            made = np.full(left.shape, -1, np.int64)
            made[known] = self.merges.get(mixed(self._pair(left[known], right[known]).astype(np.uint64)))
            rank = np.where(made >= 0, self.rank[made], worst)
            best = rank.argmin(axis=1)
            some = rank[np.arange(len(live)), best] < worst
            live, best, made = live[some], best[some], made[some]
            if not len(live):
                break
            now[live, best] = made[np.arange(len(live)), best]
            columns = np.arange(width - 1)[None, :]
            shifted = np.where(columns > best[:, None], now[live, 1:], now[live, :-1])
            now[live, :-1] = shifted
            now[live, -1] = -1
        return (now[:, 0] == a) & (now[:, 1 if width > 1 else 0] == b) & ((now >= 0).sum(axis=1) == 2)

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can follow piece a."""
        if self.kind == UNIGRAM:
            return np.ones(len(a), bool)
        key = self._pair(a.astype(np.uint64), b.astype(np.uint64)) if len(a) else np.zeros(0, np.uint64)
        slot = (mixed(key) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        held = self.pairs[slot]
        two = np.uint64(2)
        out = held % two == 0
        new = np.flatnonzero((held + np.uint64(1)) // two != key + np.uint64(1))
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            good = self._merged_apart(a[new][first].astype(np.int64), b[new][first].astype(np.int64))
            out[new] = good[back]
            self.pairs[slot[new][first]] = two * (keys + np.uint64(1)) - np.where(good, 0, 1).astype(np.uint64)
        return out

    # -- shortest paths --------------------------------------------------------------------

    def _solve_equal(self, words: list[str]) -> list[bytes]:
        """Ids of the best paths of words of one length, all at a time."""
        n, size = len(words), len(words[0])
        prefix = _prefix(_points(words).reshape(n, size))
        last = np.full((n, size + 1), -1, np.int32)
        took = np.zeros((n, size + 1), np.int32)
        cost = np.full((n, size + 1), np.inf)
        cost[:, 0] = 0
        for end in range(1, size + 1):
            open_ = np.arange(n)  # arcs of a BPE model weigh nothing: the first that can stand settles a word's place
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                piece = self.lookup.get(mixed((prefix[open_, end] - prefix[open_, start]) * INVERSES.upto(start + 1)[start]))
                if length == 1:
                    piece = np.where(piece < 0, self.other, piece)
                some = np.flatnonzero((piece >= 0) & np.isfinite(cost[open_, start]))
                rows, piece = open_[some], piece[some]
                if start and len(rows):
                    fits = self.stand(last[rows, start], piece)
                    rows, piece = rows[fits], piece[fits]
                if not len(rows):
                    continue
                total = cost[rows, start] + (self.weight[piece] if self.kind == UNIGRAM else 0.0)
                better = total < cost[rows, end]
                rows = rows[better]
                cost[rows, end], last[rows, end], took[rows, end] = total[better], piece[better], length
                if self.kind == BPE:
                    open_ = open_[np.isinf(cost[open_, end])]
                    if not len(open_):
                        break
        place = np.full(n, size)
        steps = []
        while (place > 0).any():
            live = place > 0
            steps.append(np.where(live, last[np.arange(n), place], -1))
            place = np.where(live, place - took[np.arange(n), place], 0)
        table = np.array(steps).T[:, ::-1].astype("<i4")
        real = table >= 0
        body = table[real].tobytes()
        ends = (np.cumsum(real.sum(axis=1)) * 4).tolist()
        out = [body[x:y] for x, y in zip([0, *ends], ends)]
        for i in np.flatnonzero((table == self.other).any(axis=1)):
            out[i] = self._ids(words[i], table[i][real[i]].tolist())
        return out

    def _solve_long(self, word: str) -> list[int]:
        """Best path of one word, place by place.

        All arcs of a BPE model weigh nothing, so the first piece that can stand there settles a place.
        """
        size, unigram, names, none = len(word), self.kind == UNIGRAM, self.by_name, float("inf")
        last, took, cost = [-1] * (size + 1), [0] * (size + 1), [none] * (size + 1)
        cost[0] = 0.0
        for end in range(1, size + 1):
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                piece = names.get(word[start:end], self.other if length == 1 else -1)
                if piece < 0 or cost[start] == none:
                    continue
                if not unigram:
                    if not start or self._stand_one(last[start], piece):
                        last[end], took[end], cost[end] = piece, length, 0.0
                        break
                elif (total := cost[start] + float(self.weight[piece])) < cost[end]:
                    last[end], took[end], cost[end] = piece, length, total
        path, place = [], size
        while place:
            path.append(last[place])
            place -= took[place]
        return path[::-1]

    def _stand_one(self, a: int, b: int) -> bool:
        """``stand`` of one pair, remembered."""
        key = a * (self.other + 1) + b
        found = self.beside.get(key)
        if found is None:
            now = [int(c) for x in (a, b) for c in self.chars[x] if c >= 0]
            while True:
                made = [self.merge_of.get(self._pair(x, y), -1) for x, y in zip(now, now[1:])]
                best = min((self.ranks[m], i) for i, m in enumerate(made) if m >= 0) if any(m >= 0 for m in made) else None
                if best is None:
                    break
                now[best[1] : best[1] + 2] = [made[best[1]]]
            found = now == [a, b]
            if len(self.beside) < self.remembered:
                self.beside[key] = found
        return found

    def _ids(self, word: str, path) -> bytes:
        """Ids of a path; characters that are no piece become their bytes, or unknown without byte pieces."""
        if self.other not in path:
            return np.asarray(path, "<i4").tobytes()
        out, at = [], 0
        for piece in path:
            if piece != self.other:
                out.append(int(piece))
                at += len(self.names[piece])
            else:
                raw = word[at].encode("utf-8", "surrogatepass")
                out.extend([self.bytes[b] for b in raw] if self.bytes else [self.unknown])
                at += 1
        return np.array(out, "<i4").tobytes()

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of words whose spaces are escaped."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        for size, members in by_size.items():
            if not size:
                continue
            if size > LONG:
                for i in members:
                    out[i] = self._ids(words[i], self._solve_long(words[i]))
                continue
            for at in range(0, len(members), 1 << 14):
                some = members[at : at + (1 << 14)]
                for i, ids in zip(some, self._solve_equal([words[i] for i in some])):
                    out[i] = ids
        return out

    # -- texts -----------------------------------------------------------------------------

    def _cut(self, text: str) -> list[tuple[list[str], list[str]]]:
        """Lines of (parts as they stand, words after one space)."""
        text = text.replace(SPACE, " ")
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy:
            text = " " + text
        lines = []
        for line in text.split("\n"):
            if "  " in line or line.endswith(" "):
                lines.append((re.findall(" *[^ ]+| +", line), []))
            else:
                first, *rest = line.split(" ")
                lines.append(([first] if first else [], rest))
        return lines

    def _known(self, table: dict[str, bytes], words: list[str], before: str) -> dict[str, bytes]:
        """Ids of different words, those remembered and those solved now."""
        found = dict(zip(words, map(table.get, words)))
        new = [x for x, ids in found.items() if ids is None]
        solved = dict(zip(new, self.solve([before + x.replace(" ", SPACE) for x in new])))
        if len(table) < self.remembered:
            table.update(solved)
        found.update(solved)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian 32-bit numbers."""
        cut = [self._cut(t) if t else [] for t in texts]
        heads, words = set(), set()
        for lines in cut:
            for head, rest in lines:
                heads.update(head)
                words.update(rest)
        head = self._known(self.heads, list(heads), "").__getitem__
        word = self._known(self.words, list(words), SPACE).__getitem__
        feed = self._ids("\n", [self.other])
        return [feed.join([b"".join(map(head, x)) + b"".join(map(word, y)) for x, y in lines]) for lines in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the dummy prefix goes, bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def compile_model(path: str, remembered: int = REMEMBERED) -> Transducer:
    """One transducer for each process and model file."""
    return kept(("pieces", path, remembered), lambda: Transducer(path, remembered))


def encode(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None, digest: bool = False,
           remembered: int = REMEMBERED) -> DataFrame:
    """The columns ``carry`` (default all but the text) with n_pieces, exact (whether decoding gives
    the text back) and ``ids`` (array of int); with ``digest`` ids_crc32 (of the ids as
    little-endian 32-bit numbers) and text_crc32 (of the decoded text) instead of ids.

    A worker remembers the ids of ``remembered`` words, about 200 bytes each, and solves others
    wherever they turn up."""
    added = ("n_pieces", "exact", "ids", "ids_crc32", "text_crc32")
    carried = [c for c in (carry if carry is not None else [c for c in docs.columns if c != text]) if c not in added]
    schema = docs.select(*carried).schema.add("n_pieces", "long").add("exact", "boolean")
    schema = schema.add("ids_crc32", "long").add("text_crc32", "long") if digest else schema.add("ids", T.ArrayType(T.IntegerType()))
    names = schema.fieldNames()

    def work(batches):
        machine = compile_model(model, remembered)
        for batch in batches:
            for first, last, _, _ in segments(batch.column(0).fill_null(""), RUN_BYTES):
                some = batch.slice(first, last - first)
                texts = some.column(0).fill_null("").to_pylist()
                found = machine.encode(texts)
                back = [machine.decode(x) for x in found]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                exact = pa.array([a == b for a, b in zip(texts, back)], pa.bool_())
                if digest:
                    tail = [pa.array([zlib.crc32(x) for x in found], pa.int64()),
                            pa.array([zlib.crc32(x.encode()) for x in back], pa.int64())]
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    tail = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(sizes), exact, *tail], names)

    return in_tasks(docs.select(F.col(text).alias("__text"), *carried), work, schema, keeps=True)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``text`` in place of its ids; null ids give an empty text."""
    carried = [c for c in encoded.columns if c not in (ids, "text")]
    schema = encoded.select(*carried).schema.add("text", "string")

    def work(batches):
        machine = compile_model(model)
        for batch in batches:
            column = batch.column(0)
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            texts = [machine.decode(flat[x:y].tobytes()) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*carried, "text"])

    return in_tasks(encoded.select(F.col(ids).alias("__ids"), *carried), work, schema, keeps=True)
