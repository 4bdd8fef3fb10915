"""Token ids in Arrow files of equal-length sequences.

Documents are put in order of id, dealt by range, and each partition writes a pair of Arrow
IPC files: ``ids`` with batches of fixed-size lists (sequences of ids, and masks: whether a
place holds an id, and whether it is a document's last), and ``docs`` with each document's
key, first place and length.  The ids of a partition run on from sequence to sequence; only
its last sequence is filled up, under mask 0.  All batches but the last hold the same number
of sequences, so sequence k is row k % rows of batch k // rows, and an uncompressed file
opened as a memory map gives its ids without a copy.

A file's name is new for every attempt of a task and is reported only by the attempt that
Spark commits, so lost executors and second attempts leave no wrong or double file in the
manifest.

Encoding uses the tokenizers library.  Its pre-tokenizer starts a new word at a single space
between two characters that are no white space, so texts are cut there and each different
word is encoded once while it is remembered (``Encoder``); the ids are those of the whole text.

Defined results: null and empty texts give the end id alone; rows of null id stand last;
rows of equal id stand in the order of their texts; an empty table writes no file.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tilth.llm.base import in_tasks, kept, segments
from tilth.session import fresh_path, staged

LENGTH = 2048
#: Sequences in a batch.
ROWS = 64
END = 2
# white space as Python or the tokenizer's pattern sees it, but for the space and the line feed
_RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = r"\s\x1c-\x1f\x85"
#: Before a space that has no white space on either side.
_CUT = re.compile(f"(?<=[^{_WHITE}])(?= [^{_WHITE}])")
#: A letter and a mark that is no apostrophe: between them, too, the pre-tokenizer starts a new word.
_INNER = "([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\\[-`{-~])"
#: Bytes of text encoded together.
RUN_BYTES = 1 << 22
#: Pieces an encoder remembers; those that come later are encoded wherever they turn up.
REMEMBERED = 1_000_000


def _plain(text: str) -> bool:
    """Whether every space of a text has other characters than white space on both sides."""
    if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    return text.isascii() and text.isprintable() or not any(c in text for c in _RARE)


class Encoder:
    """Ids of whole texts; a piece of text is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = {i: t.content for i, t in self.model.get_added_tokens_decoder().items()}
        self.added = list(added.values())
        names = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size())]
        # a character of a byte-level token stands for a byte
        self.sizes = np.array([len(added[i].encode()) if i in added else len(n or "") for i, n in enumerate(names)], np.int64)
        self.pieces: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces.  Those after a space are encoded in a row: their bytes say where one
        ends, as no token crosses from a piece to the next."""
        out, wide = {}, self.kind.itemsize
        row = [x for x in new if len(x) > 1 and x[0] == " " and x[-1] not in " \n"]
        for at in range(0, len(row), 4096):
            some = row[at : at + 4096]
            ids = np.array(self.model.encode("".join(some), add_special_tokens=False).ids, self.kind)
            ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in some])
            last = ((np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * wide).tolist()
            raw = ids.tobytes()
            out.update(zip(some, [raw[x:y] for x, y in zip([0, *last], last)]))
        rest = [x for x in new if x not in out]
        for x, found in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False) if rest else []):
            out[x] = np.array(found.ids, self.kind).tobytes()
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        found = list(map(self.pieces.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self._learn([pieces[i] for i in missing])
            for i in missing:
                found[i] = new[pieces[i]]
            if len(self.pieces) < REMEMBERED:
                self.pieces.update(new)
        return found

    def _whole(self, text: str) -> np.ndarray:
        """A text with unusual white space, cut only where that is safe."""
        parts = _CUT.split(text)
        found = dict(zip(set(parts), self._known(list(set(parts)))))
        return np.frombuffer(b"".join(map(found.__getitem__, parts)), self.kind)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column without nulls."""
        listed = texts.to_pylist()
        plain = np.array([_plain(t) and "\x00" not in t and not any(a in t for a in self.added) for t in listed], bool)
        out: list = [None if p else self._whole(t) for t, p in zip(listed, plain)]
        even = np.flatnonzero(plain)
        if not len(even):
            return out
        marked = pc.replace_substring(texts.take(pa.array(even)), " ", "\x00 ")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, _INNER, "\\1\x00\\2"), "\x00")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        pieces = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(pieces), self.kind)
        each = sizes[place]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(starts[place] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[ends].tolist()
        for i, x, y in zip(even, cuts, cuts[1:]):
            out[i] = ids[x:y]
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each process and vocabulary."""
    return kept(("tokens", path), lambda: Encoder(path))


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def ids_schema(kind: np.dtype, length: int) -> pa.Schema:
    number = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([
        ("ids", pa.list_(number, length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length)),
    ], metadata={"length": str(length)})


class SequenceWriter:
    """Writes a run of documents as equal-length sequences, a batch at a time."""

    def __init__(self, uri: str, kind: np.dtype, length: int, rows: int):
        self.kind, self.length, self.size = kind, length, length * rows
        system, path = _place(uri)
        self.sink = system.open_output_stream(path)
        self.schema = ids_schema(kind, length)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.ends: list[int] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        self.ends.append(self.waiting - 1)
        if self.waiting >= self.size:
            self._flush(self.waiting // self.size * self.size)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        ends = np.array(self.ends, np.int64)
        for at in range(0, n, self.size):
            self._batch(every[at : at + self.size], ends[(ends >= at) & (ends < at + self.size)] - at)
        self.held, self.waiting = [every[n:]], len(every) - n if len(every) > n else 0
        self.ends = (ends[ends >= n] - n).tolist()

    def _batch(self, ids: np.ndarray, ends: np.ndarray) -> None:
        filled = -(-len(ids) // self.length) * self.length
        body, mask, last = np.zeros(filled, self.kind), np.zeros(filled, bool), np.zeros(filled, bool)
        body[: len(ids)], mask[: len(ids)], last[ends] = ids, True, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (body, mask, last)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(self.waiting // self.size * self.size)
        if self.waiting:
            self._flush_rest()
        self.file.close()
        self.sink.close()

    def _flush_rest(self) -> None:
        every = np.concatenate(self.held)
        self._batch(every, np.array(self.ends, np.int64))
        self.held, self.ends, self.waiting = [], [], 0


def write_sequences(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = END, length: int = LENGTH,
                    rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents; the manifest: (part, file, documents, tokens, start), one row a file.

    ``start`` is the number of ids in all files before.  ``folder`` is shared by all executors.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sequences")
    slim = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    ordered = slim.repartitionByRange(F.col("id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(*order)
    made = ordered.select("id", "text", F.spark_partition_id().alias("part"))

    def work(batches):
        model = encoder(vocabulary)
        writer, ids, sizes, part, name = None, [], [], 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column(2)[0].as_py()
                name = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}"
                system, path = _place(folder)
                system.create_dir(path, recursive=True)
                writer = SequenceWriter(f"{name}.ids.arrow", model.kind, length, rows)
            for first, last, _, _ in segments(batch.column(1), RUN_BYTES):
                for found in model.encode(batch.column(1).slice(first, last - first)):
                    writer.add(np.append(found, model.kind.type(end)))
                    sizes.append(len(found) + 1)
            ids.append(batch.column(0))
        if writer is None:
            return
        writer.close()
        counts = np.array(sizes, np.int64)
        index = pa.table({
            "id": pa.chunked_array(ids), "first": np.cumsum(counts) - counts, "n": counts,
        })
        system, path = _place(f"{name}.docs.arrow")
        with system.open_output_stream(path) as sink, pa.ipc.new_file(sink, index.schema) as file:
            file.write_table(index, max_chunksize=1 << 16)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "file": [name], "documents": [len(counts)], "tokens": [int(counts.sum())]})

    written = staged(in_tasks(made, work, "part int, file string, documents long, tokens long", keeps=True), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Sequences:
    """A pair of files opened for reading: sequence k, and the ids from one place to another."""

    def __init__(self, name: str):
        system, path = _place(f"{name}.ids.arrow")
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = int(self.file.schema.metadata[b"length"])
        self.batches = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if self.batches else 0
        self.at, self.batch = -1, None
        system, path = _place(f"{name}.docs.arrow")
        with system.open_input_file(path) as index:
            self.docs = pa.ipc.open_file(index).read_all()

    def _columns(self, number: int):
        if number != self.at:
            self.at, self.batch = number, self.file.get_batch(number)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k; the ids are a view of the file."""
        batch, row = self._columns(k // self.rows), k % self.rows
        ids = batch.column(0)[row].values.to_numpy(zero_copy_only=True)
        return ids, batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from place ``first``: a view where they lie in one batch."""
        size, parts = self.rows * self.length, []
        while n > 0:
            number, inside = divmod(first, size)
            values = self._columns(number).column(0).flatten().to_numpy(zero_copy_only=True)
            parts.append(values[inside : inside + n])
            first, n = first + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, part) of every document, read from the files."""
    files = manifest.select("file", "start", "part")
    jobs = files.repartition(max(files.count(), 1), "file")  # a number given is not coalesced: files are read side by side

    def work(batches):
        for batch in batches:
            for name, start, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = Sequences(name)
                for block in held.docs.to_batches(max_chunksize=10_000):
                    firsts, sizes = (block.column(i).to_numpy() for i in (1, 2))
                    crcs = [zlib.crc32(held.ids(int(f), int(n)).astype("<u4").tobytes()) for f, n in zip(firsts, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [block.column(0), pa.array(firsts + start), pa.array(sizes), pa.array(crcs, pa.int64()),
                         pa.array(np.full(len(crcs), part, np.int32))],
                        ["id", "start", "n_tokens", "ids_crc32", "part"])

    return in_tasks(jobs, work, "id long, start long, n_tokens long, ids_crc32 long, part int")
