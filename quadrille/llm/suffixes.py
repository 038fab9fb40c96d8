"""Suffix dedup: removes every byte that a string of `length` bytes covers which also starts elsewhere.

Each string of `length` bytes selects one anchor within it: the position with the least hash of GRAM bytes among its
first `window` positions, the leftmost of equals. Equal strings select the same place, so two equal strings show as two
anchors whose contexts, the bytes around them that their strings span, agree. Anchors are some 1.5 % of all positions.

1. Anchors whose next length - window + 1 bytes, part of each of their strings, occur once in the corpus (by a 64-bit hash)
   are done: none of their strings repeats.
2. The suffixes at the other anchors are sorted. Each task sorts its own into a run, equal contexts once with a mark,
   and front-codes it: a suffix is the length of the prefix it shares with the one before it, and the rest.
   Splitters from samples of all runs cut the runs; the pieces are exchanged still front-coded.
3. Each range merges its pieces with a loser tree that keeps, for every head, its common prefix with the last winner: the
   longer prefix wins without a comparison, equal ones are compared behind it only.
4. Neighbours in the merged order that share the guaranteed bytes are an LCP interval. In it, a string that begins o
   bytes before its anchor repeats if another context has the same o bytes before and length - o bytes behind. The
   LCPs with both neighbours bound o from below, so strings beyond that are never looked at. This comparison is of bytes.
5. Guaranteed bytes that occur HOT times or more would make one long interval. Their contexts go no range: each distinct context
   of a run gives the 128-bit hashes of its strings, equal hashes are counted by Spark, and those that occur twice go back to
   the contexts.
6. The strings found of an anchor all hold it, so what they cover is one span; the spans go back to their documents.

Defined results: matches never cross documents; a null or empty text, or one shorter than length, loses nothing; rows equal
in doc_id and text count as two copies, both of which lose what they share; a null doc_id is one like others. Other columns
pass through, whatever their names, but n_bytes, n_removed, n_spans and kept are replaced.

Which anchors repeat is decided by the hash join of step 1; the merge decides which bytes go.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written, written_bytes
from .shingles import mix, texts

GRAM = 16
#: Bytes searched for anchors at once; positions fit the low bits of a hash.
BLOCK, LOW = 1 << 18, 22
#: Contexts in a run, samples that it gives, and contexts aimed at in a range.
RUN, SAMPLES, RANGE = 30_000, 16, 100_000
#: Anchors with the same guaranteed bytes, from which on these are counted by hashes instead of merged.
HOT = 50_000
#: Bytes of the files of spans that may be broadcast.
MAX_BROADCAST = 16 << 20


def window_of(length: int) -> int:
    """How many positions of a string may hold its anchor: two thirds, so that a third is guaranteed behind it."""
    if not 2 * GRAM <= length < 1 << 12:
        raise ValueError(f"strings of {length} bytes; {2 * GRAM} to {(1 << 12) - 1} can be looked for")
    return length - max(GRAM, length // 3) + 1


# anchors


def _anchors(data: np.ndarray, segments: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each anchor in data, with the first and last start of the strings that select it.

    segments: (begin, end) of the stretches, within which strings lie.
    """
    w = window_of(length)
    n = len(data) - 7
    if n < GRAM:
        return (np.zeros(0, np.int64),) * 3
    eight = np.empty(n, np.uint64)
    for s in range(8):
        part = np.frombuffer(data, "<u8", count=(len(data) - s) // 8, offset=s)
        eight[s::8] = part[: len(range(s, n, 8))]
    h = mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
    m = len(h)
    key = (h >> np.uint64(LOW) << np.uint64(LOW)) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64((1 << LOW) - 1)).astype(np.int64)
    at, first, last = [], [], []
    for a, b in segments:
        if b - a < length:
            continue
        own = chosen[a : b - length + 1]
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        begin = np.concatenate([[0], cut])
        at.append(own[begin])
        first.append(a + begin)
        last.append(a + np.concatenate([cut, [len(own)]]) - 1)
    if not at:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(at), np.concatenate(first), np.concatenate(last)


def _guaranteed(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each position on."""
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, size - 8, 8), size - 8]:
        word = np.zeros(len(at), np.uint64)
        for j in range(8):
            word |= data[at + k + j].astype(np.uint64) << np.uint64(8 * j)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k + 1))
    return out


def _pack(at, before, behind):
    """Anchor and the bytes (below 2**12 each) that its strings reach before it and leave out behind it, in one number."""
    return (at << 24) | (before << 12) | behind


def _unpack(x: int) -> tuple[int, int, int]:
    return x >> 24, x >> 12 & 0xFFF, x & 0xFFF


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """h, doc_id, th, x: the guaranteed bytes' hash and the packed anchor, for each anchor of each text."""
    size = length - window_of(length) + 1

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            ids, ths = batch.column("doc_id"), batch.column("th").to_numpy()
            i, n = 0, len(ids)
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1))
                begin, end = int(offsets[i]), int(offsets[j])
                for a in range(begin, max(end, begin + 1), BLOCK):  # one block, unless a text is longer
                    b = min(end, a + BLOCK + length - 1) if j == i + 1 else end
                    part = np.ascontiguousarray(data[a:b])
                    segments = [(0, b - a)] if j == i + 1 else [(int(offsets[k]) - a, int(offsets[k + 1]) - a) for k in range(i, j)]
                    at, first, last = _anchors(part, segments, length)
                    if len(at):
                        doc = np.searchsorted(offsets[i : j + 1], at + a, "right") - 1
                        doc = np.minimum(doc, j - i - 1)
                        x = _pack(at + a - offsets[i : j + 1][doc], at - first, at - last)
                        yield pa.RecordBatch.from_pydict({"h": _guaranteed(part, at, size).view(np.int64), "doc_id": ids.take(pa.array(i + doc)), "th": ths[i + doc], "x": x})
                    if j > i + 1:
                        break
                i = j

    return docs.where(F.octet_length("text") >= length).select("doc_id", "th", "text").mapInArrow(run, "h long, doc_id long, th long, x long")


# front-coded runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the longest common prefix, of which known bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:  # they differ before high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_coded(entries: list[tuple[bytes, bytes, bool]]) -> bytes:
    """Sorted (right, left, twice) as one blob."""
    prefix, rest, lefts, twice, tails, heads, before = [], [], [], [], [], [], b""
    for right, left, two in entries:
        k = common_prefix(before, right)
        prefix.append(k)
        rest.append(len(right) - k)
        lefts.append(len(left))
        twice.append(two)
        tails.append(right[k:])
        heads.append(left)
        before = right
    numbers = np.array([prefix, rest, lefts, twice], "<u2").tobytes()
    return len(entries).to_bytes(4, "little") + numbers + b"".join(tails) + b"".join(heads)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(shared prefix with the one before, right, left, twice) out of a blob."""
    n = int.from_bytes(blob[:4], "little")
    prefix, rest, lefts, twice = np.frombuffer(blob, "<u2", 4 * n, 4).reshape(4, n).tolist()
    at, head, right = 4 + 8 * n, 4 + 8 * n + sum(rest), b""
    for k, r, m, two in zip(prefix, rest, lefts, twice, strict=True):
        right = right[:k] + blob[at : at + r]
        yield k, right, blob[head : head + m], bool(two)
        at, head = at + r, head + m


def merged(blobs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(shared prefix with the one before, right, left, twice) of all runs in one order, by a loser tree.

    A head's known prefix is the one it shares with the last winner. Of two heads the one with the longer known
    prefix is the smaller; only equal ones are compared, from there on.
    """
    runs = [decoded(b) for b in blobs]
    k = len(runs)
    heads: list = [next(r, None) for r in runs]
    known = [0] * k

    def loses(a: int, b: int) -> bool:
        """Whether head a loses to head b; the loser's known prefix becomes the one it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return x is None
        if known[a] != known[b]:
            return known[a] < known[b]
        n = common_prefix(x[1], y[1], known[a])
        if x[1][n:] <= y[1][n:]:
            known[b] = n
            return False
        known[a] = n
        return True

    tree = [-1] * k  # losers at the inner nodes 1 .. k - 1

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if loses(a, b):
            a, b = b, a
        tree[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        _, right, left, two = heads[winner]
        yield known[winner], right, left, two
        heads[winner] = new = next(runs[winner], None)
        known[winner] = new[0] if new else 0  # what it shares with the one before it, the last winner
        node = (winner + k) // 2
        while node:
            if loses(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2


def _context_id(right: bytes, left: bytes) -> bytes:
    return hashlib.blake2b(left + right, digest_size=15).digest() + bytes([len(left) % 251])


def covered(group: list[tuple[int, bytes, bytes, bool]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """Of an LCP interval: (context, bytes covered before its anchor, bytes covered from it on)."""
    known: dict[tuple[bytes, bytes], list[int]] = {}  # how often, and the longest prefix shared with a neighbour
    for i, (shared, right, left, two) in enumerate(group):
        behind = group[i + 1][0] if i + 1 < len(group) else 0
        x = known.setdefault((right, left), [0, 0])
        x[0] += 1 + two
        x[1] = max(x[1], shared if i else 0, behind)
    open_ = []
    for (right, left), (n, shared) in known.items():
        if n > 1:
            yield _context_id(right, left), len(left), len(right)
        elif len(known) > 1:
            open_.append((right, left, max(length - shared, length - len(right))))
    if not open_:
        return
    found: dict[int, list[int]] = {}
    everyone = [(right, left, length - len(right), min(n, 2), -1) for (right, left), (n, _) in known.items() if n > 1] + [(right, left, low, 1, k) for k, (right, left, low) in enumerate(open_)]
    for o in range(min(x[2] for x in everyone), max(len(x[1]) for x in everyone) + 1):  # o bytes before the anchor
        here = [(left[len(left) - o :] + right[: length - o], n, k) for right, left, low, n, k in everyone if low <= o <= len(left)]
        count: Counter = Counter()
        for s, n, _ in here:
            count[s] += n
        for s, _, k in here:
            if k >= 0 and count[s] > 1:
                found.setdefault(k, []).append(o)
    for k, o in found.items():
        right, left, _ = open_[k]
        yield _context_id(right, left), o[-1], length - o[0]


# the job

_HASHED = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


@lru_cache(maxsize=2)
def _powers(length: int) -> np.ndarray:
    """Powers of the two bases, the greatest first: weights of a string's bytes."""
    out = np.ones((2, length), np.uint64)
    for k, base in enumerate(_HASHED):
        out[k, 1:] = base
    return np.multiply.accumulate(out, axis=1)[:, ::-1].copy()


def string_hashes(context: bytes, length: int) -> np.ndarray:
    """Two hashes, a row each, of every string of `length` bytes in a context."""
    data = mix(np.frombuffer(context, np.uint8).astype(np.uint64) + np.uint64(1))
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    return np.stack([mix((strings * w).sum(axis=1, dtype=np.uint64)) for w in _powers(length)])


_RUNS = {"blob": "binary", "samples": "array<binary>", "n": "long", "doc_id": "long", "th": "long", "at": "array<long>", "contexts": "array<binary>", "context": "binary", "reach": "long", "h1": "array<long>", "h2": "array<long>"}
_ARROW = {"binary": pa.binary(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _rows(size: int, /, **given) -> pa.RecordBatch:
    """A batch of _RUNS; columns that aren't given are null."""
    return pa.RecordBatch.from_pydict({c: pa.array(given[c], _ARROW[kind]) if c in given else pa.nulls(size, _ARROW[kind]) for c, kind in _RUNS.items()})


def _runs(repeated: DataFrame, length: int) -> DataFrame:
    """Rows of three kinds: runs (blob, samples, n), members (doc_id, th, at, contexts), and contexts of hot guaranteed bytes
    (context, how often as n, the bytes before its anchor as reach, its strings' hashes h1 and h2)."""

    def flush(held: Counter) -> pa.RecordBatch:
        entries = sorted((right, left, n > 1) for (right, left), n in held.items())
        step = max(1, len(entries) // SAMPLES)
        return _rows(1, blob=[front_coded(entries)], samples=[[e[0] for e in entries[step // 2 :: step]]], n=[len(entries)])

    def flush_hot(held: Counter) -> Iterator[pa.RecordBatch]:
        entries = list(held.items())
        for a in range(0, len(entries), 500):
            part = entries[a : a + 500]
            hashes = [string_hashes(left + right, length).view(np.int64) for (right, left), _ in part]
            yield _rows(len(part), context=[_context_id(*x) for x, _ in part], n=[n for _, n in part], reach=[len(left) for (_, left), _ in part], h1=[x[0] for x in hashes], h2=[x[1] for x in hashes])

    def run(batches):
        held, hot = Counter(), Counter()
        for batch in batches:
            for a in range(0, len(batch), 64):
                rows = batch.slice(a, 64)
                ids, ths, ats, contexts = [], [], [], []
                for doc_id, th, text, xs in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "th", "text", "xs")), strict=True):
                    raw, at, context = text.encode(), [], []
                    for x in xs:
                        p, before, less = _unpack(x if x >= 0 else -1 - x)
                        right, left = raw[p : p + length - less], raw[p - before : p]
                        (held if x >= 0 else hot)[right, left] += 1
                        at.append(p)
                        context.append(_context_id(right, left))
                    ids.append(doc_id)
                    ths.append(th)
                    ats.append(at)
                    contexts.append(context)
                yield _rows(len(ids), doc_id=ids, th=ths, at=ats, contexts=contexts)
                if len(held) >= RUN:
                    yield flush(held)
                    held.clear()
                if len(hot) >= RUN:
                    yield from flush_hot(hot)
                    hot.clear()
        if held:
            yield flush(held)
        yield from flush_hot(hot)

    return repeated.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in _RUNS.items()))


def _counted(hot: DataFrame, length: int) -> DataFrame:
    """context, before, behind, as _repeats gives them, of the contexts of hot guaranteed bytes."""
    each = hot.select("context", "n", "reach", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "x")).select("context", "n", "reach", "i", "x.h1", "x.h2")
    twice = written(each.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2"))
    found = each.join(twice, ["h1", "h2"]).groupBy("context", "reach").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return found.select("context", (F.col("reach") - F.col("first")).alias("before"), (F.col("last") + length - F.col("reach")).alias("behind"))


def _splitters(runs: DataFrame, size: int) -> list[bytes]:
    """Guaranteed bytes that cut the order into ranges, from at most 2 * SAMPLES samples of a run; no interval is cut."""
    total = runs.agg(F.sum("n")).collect()[0][0] or 0
    many = int(total // RANGE)
    if not many:
        return []
    sample = runs.select(F.explode("samples").alias("s")).select(F.substring("s", 1, size).alias("s"))
    # of many samples a few for each splitter are enough: by rank, so repeated ones weigh as they should
    found = sorted(bytes(r["s"]) for r in sample.orderBy(F.xxhash64("s")).limit(64 * (many + 1)).collect())
    return sorted({found[len(found) * (k + 1) // (many + 1)] for k in range(many)})


def _pieces(runs: DataFrame, splitters: list[bytes], size: int) -> DataFrame:
    """range, blob: each run cut at the splitters."""
    from bisect import bisect_right

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                piece, now = [], 0
                for _, right, left, two in decoded(blob.as_py()):
                    if now < len(splitters) and right[:size] >= splitters[now]:
                        if piece:
                            yield pa.RecordBatch.from_pydict({"range": [now], "blob": [front_coded(piece)]})
                        piece, now = [], bisect_right(splitters, right[:size])
                    piece.append((right, left, two))
                if piece:
                    yield pa.RecordBatch.from_pydict({"range": [now], "blob": [front_coded(piece)]})

    return runs.select("blob").mapInArrow(run, "range long, blob binary")


def _repeats(pieces: DataFrame, length: int) -> DataFrame:
    """context, before, behind: what is covered around the anchors of each context."""
    size = length - window_of(length) + 1

    def run(key, rows):
        out, group = [], []
        for x in merged(rows.column("blob").to_pylist()):
            if x[0] < size and group:
                out += covered(group, length)
                group = []
            group.append(x)
        if group:
            out += covered(group, length)
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"context": pa.array(columns[0], pa.binary()), "before": pa.array(columns[1], pa.int64()), "behind": pa.array(columns[2], pa.int64())})

    return pieces.groupBy("range").applyInArrow(run, "context binary, before long, behind long")


def _joined(spans: DataFrame) -> DataFrame:
    """spans with each row's overlapping or touching spans made one."""

    def run(batches):
        for batch in batches:
            out = []
            for found in batch.column("spans").to_pylist():
                row: list[dict] = []
                for s in found:  # sorted
                    if row and s["a"] <= row[-1]["b"]:
                        row[-1]["b"] = max(row[-1]["b"], s["b"])
                    else:
                        row.append(dict(s))
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "th", "spans"])

    return spans.mapInArrow(run, "doc_id long, th long, spans array<struct<a: long, b: long>>")


def repeated_spans(docs: DataFrame, *, length: int = 200) -> DataFrame:
    """doc_id, th, spans (start, end in bytes): the maximal stretches that repeat in each text, th the text's hash."""
    size = length - window_of(length) + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    held = _positions(docs, length)
    # written, so that the join reads two plain exchanges and Spark can split a frequent hash
    counts = written(held.groupBy("h").count().where("count > 1"))
    # a negative number marks an anchor with hot guaranteed bytes
    marked = held.join(counts, "h").select("doc_id", "th", F.when(F.col("count") >= HOT, -1 - F.col("x")).otherwise(F.col("x")).alias("x"))
    again = marked.groupBy("doc_id", "th").agg(F.collect_set("x").alias("xs"))
    listed = again.withColumnsRenamed({"doc_id": "__doc", "th": "__th"})
    repeated = docs.join(listed, docs["doc_id"].eqNullSafe(listed["__doc"]) & (docs["th"] == listed["__th"])).select("doc_id", "th", "text", "xs")
    rows = written(_runs(repeated, length))
    runs = rows.where("blob is not null").select("blob", "samples", "n")
    pieces = _pieces(runs.repartition(max(1, min(runs.count(), 5000))), _splitters(runs, size), size)
    hot = rows.where("h1 is not null")
    found = written(_repeats(pieces, length))
    if not hot.isEmpty():
        found = found.union(written(_counted(hot, length)))
    members = rows.where("at is not null").select("doc_id", "th", F.explode(F.arrays_zip("at", "contexts")).alias("m")).select("doc_id", "th", "m.at", F.col("m.contexts").alias("context"))
    spans = members.join(found, "context").select("doc_id", "th", F.struct((F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("behind")).alias("b")).alias("span"))
    return _joined(spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("span")).alias("spans")))


def suffix_dedup(docs: DataFrame, *, length: int = 200) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the bytes that stay."""
    added = [*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())]
    docs = docs.drop(*(x.name for x in added), "__spans")
    own = docs.columns
    spans = written(repeated_spans(docs, length=length)).withColumnsRenamed({"doc_id": "__doc", "th": "__th", "spans": "__spans"})
    spans = F.broadcast(spans) if written_bytes(spans) <= MAX_BROADCAST else spans
    df = docs.join(spans, docs["doc_id"].eqNullSafe(spans["__doc"]) & (F.xxhash64(docs["text"]) == spans["__th"]), "left").select(*(docs[c] for c in docs.columns), "__spans")

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                rows, out = batch.slice(a, 256), []
                for text, spans in zip(rows.column("text").to_pylist(), rows.column("__spans").to_pylist(), strict=True):
                    raw, kept, at, n = (text or "").encode(), [], 0, 0
                    for s in spans or []:
                        kept.append(raw[at : s["a"]])
                        at, n = s["b"], n + 1
                    kept.append(raw[at:])
                    kept = b"".join(kept)
                    out.append((len(raw), len(raw) - len(kept), n, kept))
                columns = [pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in own), *columns], [*own, *(x.name for x in added)])

    return df.mapInArrow(run, T.StructType([*docs.schema, *added]))
