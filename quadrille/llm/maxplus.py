"""SentencePiece encoding and decoding: by merges for BPE models, as a max-plus parallel scan for unigram models.

The ids are those that SentencePieceProcessor.encode gives with the same, unmodified model; its file says which kind it is.

BPE: a greedy order of merges is no sum of scores, so there is no scan. But no merge makes what no piece holds: between
two characters that stand side by side in no piece, a text falls apart into parts whose merges don't touch. Words
are such parts where no piece reaches from a visible character into the space behind it; they are encoded one by one
by the library and kept in a bounded cache. A giant text is split into chunks at such places, its chunks are encoded in
different tasks and joined. A stretch without such a place (one letter a million times) stays in one chunk.

Unigram: a text is segmented into pieces of a SentencePiece vocabulary so that the sum of the pieces' scores is the greatest: the
best path of a lattice over its characters (unigram semantics, byte fallback for characters that no piece covers). The
path is found by Viterbi, with these cuts: no piece reaches from a visible character into the space behind it, so
words are segmented apart and a bounded cache keeps them.

A giant text is split into chunks anywhere. A boundary's state is how far the piece across it reaches into the next
chunk. Each chunk yields a matrix of best scores from each state at its start to each at its end; matrices combine
associatively in the max-plus sense, level by level in groups of FAN; from the top the states at all boundaries
come back down the levels; then each chunk, knowing its two states, backtraces its own pieces. No task sees more than
one chunk or FAN matrices of a text.

Scores are whole numbers of 2**-24, so sums don't depend on their order. Where several segmentations have the same greatest
score, that with the greatest sum of TIES decides, one for each boundary by its place in its word; it adds up like the
score, so chunks of any size give the ids of the whole text.

Decoding concatenates the pieces' bytes and restores spaces. As SentencePiece does, it reads the character U+2581 as a
space; all other texts come back as they were. Defined results: a null text has no ids (null), an empty one no pieces;
rows with equal texts get equal ids, those with a null doc_id too. All columns pass through; ids, if there before, is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .shingles import mix

SPACE = "▁"
#: Matrices that one task combines.
FAN = 64
#: Words kept between batches.
MAX_CACHE = 200_000
#: Characters of the longest word that is kept.
MAX_WORD = 200
#: Kinds of models, as in the file.
UNIGRAM, BPE = 1, 2
#: Scores are rounded to whole numbers of this; below a score stands, in 64 bits of its own, the sum of its boundaries' ties.
UNIT, TIE_BITS = 1 << 24, 64
#: Less than any score: of one path, as a Python number and in a matrix.
NONE, LOW = -(1 << 130), -(1 << 61)
#: What encode and decode add.
_ADDED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
_ties: list[int] = []


def tie(place: int) -> int:
    """A fixed 40-bit number for each place in a word."""
    while place >= len(_ties):
        _ties.extend((mix(np.arange(len(_ties), 2 * len(_ties) + 64, dtype=np.uint64) + np.uint64(1)) >> np.uint64(24)).tolist())
    return _ties[place]


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MARKS = ".,;:!?|#$%&*\"'()"


class Pieces:
    """A SentencePiece vocabulary as a lattice of scores."""

    def __init__(self, model: str | None = None, proto: bytes | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.score: dict[str, tuple[int, int]] = {}
        self.byte = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece] = (round(sp.get_score(i) * UNIT) << TIE_BITS, i)
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values()) - (10 * UNIT << TIE_BITS)
        self.begins = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}
        self.scores: dict[str, int] = {}

    def paths(self, s: str, n: int, start: int = 0, lead: int = 0) -> tuple[list[int], list[int]]:
        """best[e] and back[e], where the last piece of the best path to e begins, over pieces that begin in [start, n).

        s begins lead characters into a word.
        """
        best, back = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        best[start] = 0
        score, begins, end = self.score, self.begins, len(s)
        tie(lead + end)
        for i in range(start, n):
            if (here := best[i]) == NONE:
                continue
            e, single = i + 1, False
            while e <= end and (part := s[i:e]) in begins:
                if (hit := score.get(part)) is not None:
                    single |= e == i + 1
                    if (new := here + hit[0] + _ties[lead + e]) > best[e]:
                        best[e], back[e] = new, i
                e += 1
            if not single and (new := here + self.unknown + _ties[lead + i + 1]) > best[i + 1]:
                best[i + 1], back[i + 1] = new, i
        return best, back

    def trace(self, s: str, back: list[int], end: int, start: int = 0) -> list[int]:
        """The ids of the best path from start to end."""
        out = []
        while end > start:
            i = back[end]
            hit = self.score.get(s[i:end])
            out.append([hit[1]] if hit is not None else [self.byte[b] for b in s[i:end].encode()])
            end = i
        return [x for ids in reversed(out) for x in ids]

    def _atom(self, s: str) -> None:
        _, back = self.paths(s, len(s))
        self.words[s] = np.array(self.trace(s, back, len(s)), "<i4").tobytes()

    def learn(self, new: set[str]) -> None:
        """Words into the cache."""
        for word in new:
            if word not in self.words:
                self._atom(word)

    def best(self, word: str) -> int:
        """The score of a word's best path; only chunks need it."""
        if (found := self.scores.get(word)) is None:
            found = self.scores[word] = self.paths(word, len(word))[0][-1]
        return found

    def trim(self) -> None:
        for cache in (self.words, self.scores):
            if len(cache) > MAX_CACHE:
                cache.clear()

    def cut(self, text: str) -> list[str]:
        """The words of a text, with its first space added."""
        if "  " in text or SPACE in text or text[:1] == " ":
            return _WORD.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + x for x in text.split(" ")]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        self.trim()
        cut = [None if t is None else self.cut(t) if t else [] for t in texts]
        self.learn({x for c in cut if c for x in c} - self.words.keys())
        get = self.words.__getitem__
        return [None if c is None else b"".join(map(get, c)) for c in cut]

    # chunks: s holds the chunk's n characters and, behind them, the longest piece's rest

    def _cuts(self, s: str, n: int) -> tuple[int, int] | None:
        """The first and the last position in the chunk where a word begins behind a visible character."""
        found = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", s[:n])]
        return (found[0], found[-1]) if found else None

    def matrix(self, s: str, n: int, lead: int) -> np.ndarray:
        """Best scores, and their ties, from each state at the chunk's start to each at its end."""
        m = self.longest
        out = np.stack([np.full((m, m), LOW), np.zeros((m, m), np.int64)])

        def put(d: int, values: list[int]) -> None:
            for e, x in enumerate(values):
                if x > NONE // 2:
                    out[:, d, e] = x >> TIE_BITS, x & ((1 << TIE_BITS) - 1)

        cuts = self._cuts(s, n)
        if cuts is None:
            for d in range(m):
                if d >= n:
                    if d - n < m:
                        out[:, d, d - n] = 0
                else:
                    put(d, self.paths(s, n, d, lead)[0][n:])
            return out
        f, g = cuts
        tail, _ = self.paths(s[g:], n - g)
        between = _WORD.findall(s[f:g])
        middle = sum(map(self.best, between))
        for d in range(min(m, f + 1)):
            head, _ = self.paths(s[:f], f, d, lead)
            put(d, [head[f] + middle + x for x in tail[n - g :]])
        return out

    def pieces(self, s: str, n: int, lead: int, enter: int, leave: int) -> bytes:
        """The ids of the pieces that begin in the chunk, given its states."""
        if enter >= n:
            return b""
        cuts = self._cuts(s, n)
        if cuts is None:
            _, back = self.paths(s, n, enter, lead)
            return np.array(self.trace(s, back, n + leave, enter), "<i4").tobytes()
        f, g = cuts
        _, head = self.paths(s[:f], f, enter, lead)
        _, tail = self.paths(s[g:], n - g)
        between = _WORD.findall(s[f:g])
        self.learn(set(between))
        first, last = self.trace(s[:f], head, f, enter), self.trace(s[g:], tail, n - g + leave)
        return np.array(first, "<i4").tobytes() + b"".join(map(self.words.__getitem__, between)) + np.array(last, "<i4").tobytes()


class Merges:
    """A BPE model; parts of a text between cuts are encoded apart."""

    def __init__(self, model: str):
        import sentencepiece

        # the space in front is added to a text here, once, not to each of its parts: normalizer_spec.add_dummy_prefix = false
        with open(model, "rb") as f:
            self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x1a\x02\x18\x00")
        held = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.pairs = {p[k : k + 2] for p in held for k in range(len(p) - 1)}
        self.apart = not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        self.words: dict[str, bytes] = {}

    def atom(self, s: str) -> bytes:
        return np.array(self.sp.encode(s), "<i4").tobytes()

    def word(self, s: str) -> bytes:
        """The ids of a word; marks behind it are apart from it where no piece has both."""
        if (found := self.words.get(s)) is not None:
            return found
        stem = s.rstrip(_MARKS)
        marks = s[len(stem) :]
        if marks and stem and stem[-1] + marks[0] not in self.pairs:
            found = self.word(stem) + self.word(marks)
        else:
            found = self.atom(s)
        if len(s) <= MAX_WORD:
            self.words[s] = found
        return found

    def part(self, s: str) -> bytes:
        """The ids of a part of a text whose spaces are replaced."""
        if len(self.words) > MAX_CACHE:
            self.words.clear()
        return b"".join(map(self.word, _WORD.findall(s))) if self.apart else self.atom(s)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        return [None if t is None else self.part(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts]

    def chunks(self, s: str, size: int) -> list[str]:
        """Parts of about size characters between cuts: the last cut within size, else the next one beyond."""
        out, a = [], 0
        while a < len(s):
            e = min(a + size, len(s))
            while a < e < len(s) and s[e - 1 : e + 1] in self.pairs:
                e -= 1
            if e == a:
                e = a + size
                while e < len(s) and s[e - 1 : e + 1] in self.pairs:
                    e += 1
            out.append(s[a:e])
            a = e
        return out


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer: an integer, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


@lru_cache(maxsize=4)
def kind_of(model: str) -> int:
    """The model's kind, from its trainer_spec.model_type; unigram where it's left out."""
    with open(model, "rb") as f:
        spec = [x for number, x in _fields(f.read()) if number == 2]
    kind = ([x for number, x in _fields(spec[-1]) if number == 3] if spec else []) or [UNIGRAM]
    if kind[-1] not in (UNIGRAM, BPE):
        raise ValueError(f"neither a unigram nor a BPE model: {model}")
    return kind[-1]


@lru_cache(maxsize=1)
def pieces_of(model: str) -> Pieces | Merges:
    """One vocabulary a worker process, so that tasks after the first find its cache filled."""
    return Merges(model) if kind_of(model) == BPE else Pieces(model)


def _raw(sp, i: int) -> bytes:
    if sp.is_byte(i):
        return bytes([int(sp.id_to_piece(i)[1:-1], 16)])
    return b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i).encode()


@lru_cache(maxsize=1)
def raw_pieces(model: str) -> pa.Array:
    """The bytes of each piece, all that decoding needs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return pa.array([_raw(sp, i) for i in range(sp.get_piece_size())], pa.large_binary())


def _greatest(scores: np.ndarray, ties: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest score along an axis and the greatest tie that goes with it."""
    best = scores.max(axis=axis)
    return np.maximum(best, LOW), np.where(scores == np.expand_dims(best, axis), ties, -1).max(axis=axis)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices, by score, then tie."""
    return np.stack(_greatest(a[0][:, :, None] + b[0][None], a[1][:, :, None] + b[1][None], 1))


def _lists(ids: list[bytes | None]) -> pa.Array:
    ends = np.cumsum([0] + [len(x or b"") // 4 for x in ids])
    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4")))
    if any(x is None for x in ids):
        return pc.if_else(pa.array([x is not None for x in ids]), out, pa.nulls(len(ids), out.type))
    return out


def _decoded(lists: pa.Array, raw: pa.Array) -> pa.Array:
    """The texts of lists of ids."""
    space, out, at = SPACE.encode(), [], 0
    taken = raw.take(lists.flatten())
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = memoryview(data) if data is not None else b""
    for n in pc.list_value_length(lists).to_pylist():
        if n is None:
            out.append(None)
            continue
        text = bytes(data[ends[at] : ends[at + n]]).replace(space, b" ") if n else b""
        out.append(text.removeprefix(b" ").decode(errors="replace"))
        at += n
    return pa.array(out, pa.string())


def _encode_whole(docs: DataFrame, model: str, decoded: bool) -> DataFrame:
    def run(batches):
        pieces, raw = pieces_of(model), raw_pieces(model) if decoded else None
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(texts), 512):
                ids = _lists(pieces.encode(texts[a : a + 512].to_pylist()))
                rows = batch.slice(a, 512)
                more = [ids, _decoded(ids, raw)] if decoded else [ids]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, *_ADDED.names[: len(more)]])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *_ADDED.fields[: 1 + decoded]]))


_CHUNK = "doc_id long, th long, c long, n long, lead long, s string"


def _chunks(giants: DataFrame, longest: int, size: int) -> DataFrame:
    """The chunks of each text: s is its first n characters, which begin lead characters into a word, and the next longest - 1."""

    def run(batches):
        for batch in batches:
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                s = SPACE + text.replace(" ", SPACE)
                word, starts = 0, (m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", s))
                after = next(starts, len(s))
                for c, a in enumerate(range(0, len(s), size)):
                    while after <= a < len(s):
                        word, after = after, next(starts, len(s))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "th": [th], "c": [c], "n": [min(size, len(s) - a)], "lead": [a - word], "s": [s[a : a + size + longest - 1]]})

    return giants.mapInArrow(run, _CHUNK)


def _encode_parts(giants: DataFrame, model: str, size: int) -> DataFrame:
    """doc_id, th, c, ids: the chunks between cuts of each text, encoded in different tasks."""

    def cut(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                for c, s in enumerate(pieces.chunks(SPACE + text.replace(" ", SPACE), size)):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "th": [th], "c": [c], "s": [s]})

    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for a in range(0, len(batch), 16):
                rows = batch.slice(a, 16)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "th", "c")), _lists([pieces.part(s) for s in rows.column("s").to_pylist()])], ["doc_id", "th", "c", "ids"])

    chunks = giants.mapInArrow(cut, "doc_id long, th long, c long, s string").repartition("doc_id", "th", "c")
    return chunks.mapInArrow(run, "doc_id long, th long, c long, ids array<int>")


def _encode_scanned(giants: DataFrame, model: str, size: int) -> DataFrame:
    chunks = written(_chunks(giants, pieces_of(model).longest, size)).repartition("doc_id", "th", "c")
    return _encode_chunks(chunks, _states(written(_matrices(chunks, model))), model)


def _matrices(chunks: DataFrame, model: str) -> DataFrame:
    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for i in range(len(batch)):
                pieces.trim()
                m = pieces.matrix(*(batch.column(c)[i].as_py() for c in ("s", "n", "lead")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("doc_id", "th", "c")), pa.array([m.tobytes()])], ["doc_id", "th", "c", "m"])

    return chunks.select("doc_id", "th", "c", "n", "lead", "s").mapInArrow(run, "doc_id long, th long, c long, m binary")


def _unpacked(m: bytes) -> np.ndarray:
    m = np.frombuffer(m, np.int64)
    return m.reshape(2, int((len(m) // 2) ** 0.5), -1)


def _states(matrices: DataFrame) -> DataFrame:
    """doc_id, th, c, enter, leave: the states around each chunk, by a scan up and down the levels."""
    keys = ["doc_id", "th", "up"]
    levels = [matrices]

    def product(pdf):
        out = None
        for m in pdf.sort_values("c")["m"]:
            out = _unpacked(m) if out is None else combine(out, _unpacked(m))
        return pdf.head(1)[keys].rename(columns={"up": "c"}).assign(m=[out.tobytes()])

    above = lambda df: df.withColumn("up", F.floor(F.col("c") / FAN).cast("long"))
    while not levels[-1].where("c > 0").isEmpty():
        levels.append(written(above(levels[-1]).groupBy(*keys).applyInPandas(product, "doc_id long, th long, c long, m binary")))

    def inside(pdf):
        pdf = pdf.sort_values("c")
        ms, enter, leave = [_unpacked(m) for m in pdf["m"]], int(pdf["enter"].iloc[0]), int(pdf["leave"].iloc[0])
        size = ms[0].shape[1]
        reach = [(np.where(np.arange(size) == enter, 0, LOW), np.zeros(size, np.int64))]
        for m in ms:
            reach.append(_greatest(reach[-1][0][:, None] + m[0], reach[-1][1][:, None] + m[1], 0))
        states = [leave]
        for m, (score, ties) in zip(reversed(ms), reversed(reach[:-1]), strict=True):
            to = states[-1]
            states.append(int(np.lexsort((ties + m[1][:, to], score + m[0][:, to]))[-1]))
        states.reverse()
        return pdf[["doc_id", "th", "c"]].assign(enter=states[:-1], leave=states[1:])

    top = levels[-1].select("doc_id", "th", "c", F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("leave"))
    for level in reversed(levels[:-1]):
        known = top.withColumnRenamed("c", "up")
        top = written(above(level).join(known, keys).groupBy(*keys).applyInPandas(inside, "doc_id long, th long, c long, enter long, leave long"))
    return top


def _encode_chunks(chunks: DataFrame, states: DataFrame, model: str) -> DataFrame:
    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for i in range(len(batch)):
                pieces.trim()
                ids = pieces.pieces(*(batch.column(c)[i].as_py() for c in ("s", "n", "lead", "enter", "leave")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("doc_id", "th", "c")), _lists([ids])], ["doc_id", "th", "c", "ids"])

    return chunks.join(states, ["doc_id", "th", "c"]).select("doc_id", "th", "c", "s", "n", "lead", "enter", "leave").mapInArrow(run, "doc_id long, th long, c long, ids array<int>")


def encode(docs: DataFrame, model: str, *, chunk: int = 1 << 15, decoded: bool = False) -> DataFrame:
    """docs with ids; texts of more than `chunk` characters are encoded in chunks of about that size.

    decoded: with decoded, too, as decode gives it; other texts are encoded and decoded by one Python worker a task, not two."""
    docs = docs.drop("ids", *(["decoded"] if decoded else []))
    whole = _encode_whole(docs.where(F.col("text").isNull() | (F.length("text") <= chunk)), model, decoded)
    # chunks meet by (__key, hash), which are never null; which doc_id stands for a null one doesn't matter, equal texts have equal ids
    giants = docs.where(F.length("text") > chunk).withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn("__th", F.xxhash64("text"))
    if giants.isEmpty():
        return whole
    each = giants.select(F.col("__key").alias("doc_id"), F.col("__th").alias("th"), "text").dropDuplicates(["doc_id", "th"])
    ids = (_encode_parts if kind_of(model) == BPE else _encode_scanned)(each, model, chunk)
    ids = ids.groupBy("doc_id", "th").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))
    ids = ids.withColumnsRenamed({"doc_id": "__doc", "th": "__h"})
    found = giants.join(ids, (giants["__key"] == ids["__doc"]) & (giants["__th"] == ids["__h"]))
    found = found.select(*docs.columns, "ids")
    return whole.unionByName(decode(found, model) if decoded else found)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with decoded, the text of ids; a column of that name is replaced."""
    encoded = encoded.drop("decoded")

    def run(batches):
        raw = raw_pieces(model)
        for batch in batches:
            for a in range(0, len(batch), 512):
                rows = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*rows.columns, _decoded(rows.column("ids"), raw)], [*rows.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, _ADDED["decoded"]]))
