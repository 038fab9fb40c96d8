"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id; each partition becomes one Arrow IPC file whose record batches hold
two fixed-size-list columns: ids (unsigned, 16 bits where the vocabulary allows, else 32) and mask (true for a token,
false for the padding behind a file's last token). Row i of a file is the sequence i: a reader that maps the file gets any
sequence without a copy. Beside it a small Arrow file lists the documents in order with their numbers of tokens.
Documents run on across sequences, so only the last sequence of a file is padded.

Texts are encoded by the tokenizers library. A space between two visible characters always begins a new pre-token of
a byte-level BPE, and so do marks behind a letter, so texts are cut there by Arrow's functions and the library encodes each
distinct piece of a batch once; a bounded cache keeps pieces between batches. The ids equal those of encoding whole texts.

Defined results: a null or empty text has the end id only; repeated doc_ids are all written, ordered by text; null
doc_ids come first; an empty table makes no file and no rows. Columns other than doc_id and text are not written.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import file_system, shared_dir, small_enough, written

INDEX = ".docs"
#: Pieces kept between batches, about 200 bytes each.
MAX_CACHE = 1_000_000
#: Bytes of text encoded at once, unless one text is longer; pieces that go to the library as one text.
BLOCK, TOGETHER = 1 << 22, 500
#: Files whose offsets may be broadcast.
MAX_BROADCAST_FILES = 100_000
#: Neither letters, digits nor white space, nor the apostrophe of contractions: a run of them is one pre-token.
MARKS = ".,;:!?|#$%&*\"()"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Marks a piece that no space stands before.
BARE = "\x01"
#: Texts in which a space may not begin a pre-token, or that hold BARE or white space beyond ASCII (as RE2 writes it).
_ODD = r"[ \t\n\r\f]{2}|^[ \t\n\r\f]|[ \t\n\r\f]$|[\x01\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_MARKED = r"(\pL)([" + re.escape(MARKS) + r"]+)( |\n|$)"


class Encoder:
    """Texts to ids by a tokenizers file, with a bounded cache of pieces: index has a piece's place in start and size,
    which say where its ids are."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        found = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = found[0] if len(found) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, self.kind), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Pieces into the cache. A line feed before a piece and behind it is a pre-token, so many pieces go to the
        library as one text, and are cut apart at its id."""
        plain = lambda x: x[1:] if x[:1] == BARE else " " + x
        together, alone = [], []
        for x in new:
            y = x.removeprefix(BARE)
            (together if self.line is not None and y and not any(map(str.isspace, y)) and "<|" not in y else alone).append(x)
        blocks = [together[a : a + TOGETHER] for a in range(0, len(together), TOGETHER)]
        found, sizes = [], []
        for block, ids in zip(blocks, self._encoded(["\n".join(map(plain, b)) for b in blocks]), strict=True):
            at = np.flatnonzero(ids == self.line)
            ends = np.append(at, len(ids))
            n = np.diff(np.concatenate([[-1], ends])) - 1
            if len(n) != len(block):
                raise ValueError("the tokenizer joins line feeds with what stands beside them")
            found.append(np.delete(ids, at))
            sizes.append(n)
        for ids in self._encoded(list(map(plain, alone))):
            found.append(ids)
            sizes.append([len(ids)])
        size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int32)
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *found])
        self.index.update(zip([*together, *alone], range(len(self.index), len(self.index) + len(new)), strict=True))

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Each text as its pieces: cut at spaces, line feeds and before marks behind letters; an odd text is one piece."""
        odd = pc.match_substring_regex(texts, _ODD)
        cut = pc.replace_substring_regex(texts, _MARKED, rf"\1 {BARE}\2\3")
        cut = pc.replace_substring(cut, "\n", f" {BARE}\n {BARE}")
        cut = pc.binary_join_element_wise(pa.scalar(BARE, texts.type), cut, pa.scalar("", texts.type))
        if not pc.any(odd).as_py():
            return pc.split_pattern(cut, " ")
        pieces = pc.split_pattern(pc.if_else(odd, "", cut), " ").to_pylist()
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            text = texts[i].as_py()
            # where white space stands alone between visible characters, each space begins a piece
            pieces[i] = [x.removeprefix(" ") if k else BARE + x for k, x in enumerate(_CUT.split(text))] if BARE not in text else [BARE + text]
        return pa.array(pieces, pa.list_(texts.type))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, none of them null."""
        out: list[np.ndarray] = []
        _, ends = shingles.texts(texts)
        i = 0
        while i < len(texts):
            j = min(len(texts), max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1))
            out += self._block(texts[i:j])
            i = j
        return out

    def _block(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.index) > MAX_CACHE:
            self._forget()
        pieces = self._pieces(texts)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([x for x in distinct if x not in self.index])
        at, coded = np.fromiter(map(self.index.__getitem__, distinct), np.int32, len(distinct)), coded.indices.to_numpy()
        size = self.size[at][coded]
        ends = np.cumsum(size)
        kind = np.int32 if len(ends) == 0 or ends[-1] < 1 << 30 else np.int64
        where = np.repeat(self.start[at][coded] - (ends - size).astype(kind), size) + np.arange(ends[-1] if len(ends) else 0, dtype=kind)
        ids = self.ids[where]
        of_text = np.concatenate([[0], ends])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(of_text[:-1], of_text[1:], strict=True)]


@lru_cache(maxsize=1)
def encoder_of(file: str) -> Encoder:
    """One encoder a worker process, so that tasks after the first find its cache filled."""
    return Encoder(file)


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """One Arrow file of sequences, filled document by document."""

    def __init__(self, where: str, kind: np.dtype, length: int, rows: int):
        self.fs, top = file_system(where)
        self.fs.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        self.path, self.file = f"{where}/{name}", f"{top}/{name}"
        self.kind, self.length, self.size = kind, length, length * rows
        self.schema = _schema(kind, length)
        self.sink = self.fs.open_output_stream(self.file, compression=None)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n, self.docs, self.counts = bytearray(), 0, [], []

    def add(self, doc_id, ids: bytes) -> None:
        self.held += ids
        self.docs.append(doc_id)
        self.counts.append(len(ids) // self.kind.itemsize)
        self.n += self.counts[-1]
        block = self.size * self.kind.itemsize
        while len(self.held) >= block:
            self._batch(np.frombuffer(bytes(self.held[:block]), self.kind), self.size)
            del self.held[:block]

    def _batch(self, ids: np.ndarray, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < n)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(bytes(self.held), self.kind)
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.kind)]), len(ids))
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "n": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(self.file + INDEX, compression=None) as f, pa.ipc.new_file(f, index.schema) as out:
            out.write_table(index)


def write(docs: DataFrame, where: str, tokenizer: str, *, length: int = 2048, rows: int = 256, end_id: int = 0) -> DataFrame:
    """Writes the files below where; returns the written table (part, path, n) that lists them in order of doc_id."""

    def run(batches):
        out, encoder = None, encoder_of(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(texts), 2048):
                for doc_id, ids in zip(batch.column("doc_id")[a : a + 2048].to_pylist(), encoder.encode(texts[a : a + 2048].fill_null("")), strict=True):
                    out = out or _Writer(where, encoder.kind, length, rows)
                    out.add(doc_id, ids.tobytes() + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [out.path], "n": [out.n]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, path string, n long"))


def sequences(path: str) -> pa.Table:
    """The sequences of one file, mapped rather than read where the file system is local."""
    fs, file = file_system(path)
    source = pa.memory_map(file) if fs.type_name == "local" else fs.open_input_file(file)
    return pa.ipc.open_file(source).read_all()


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 of each document, from the files."""

    def run(batches):
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                fs, file = file_system(path)
                with fs.open_input_file(file + INDEX) as f:
                    index = pa.ipc.open_file(f).read_all()
                source = pa.memory_map(file) if fs.type_name == "local" else fs.open_input_file(file)
                opened = pa.ipc.open_file(source)
                held, block, crcs, starts, at = np.zeros(0, "<u4"), 0, [], [], 0
                for n in index["n"].to_pylist():
                    crc, left = 0, n
                    while left:
                        if not len(held):
                            rows = opened.get_batch(block)
                            held, block = rows.column(0).flatten().to_numpy()[: rows.column(1).flatten().true_count].astype("<u4"), block + 1
                        crc = zlib.crc32(held[:left].tobytes(), crc)
                        left, held = left - min(left, len(held)), held[left:]
                    crcs.append(crc)
                    starts.append(at)
                    at += n
                for a in range(0, len(crcs), 50_000):
                    k = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(crcs[k]), pa.int32()), index["doc_id"].combine_chunks()[k], pa.array(starts[k], pa.int64()), index["n"].combine_chunks()[k], pa.array(crcs[k], pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    # a row a file, so the running sum is small; it grows by one row for each partition of the input
    before = files.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    before = F.broadcast(before) if small_enough(files, MAX_BROADCAST_FILES) else before
    dealt = files.repartition(min(max(files.count(), 1), 20_000))
    rows = dealt.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    return read(write(docs, shared_dir(docs.sparkSession), tokenizer, **how))
