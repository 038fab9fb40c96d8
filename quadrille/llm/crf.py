"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what has no pattern.

Patterns (email, ip, card, phone) are found leftmost and without overlap per kind, then checked. The CRF tags the words
of each line with the kinds of TAGS. Its features are the shapes of a word and of its neighbours and the hashes of
cue words; it is trained by gradient ascent on the likelihood of a small labelled table (at most max_rows words), and
decoded by Viterbi over many lines at once: all lines of a piece of text advance together, word by word, in numpy.
Spans of the CRF are added where no pattern's span lies; the patterns' spans stay.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive. A line is one
sequence, however long; of a long text a few lines at a time are in numpy. Rows are handled one by one, so repeated rows get equal results; columns besides text
pass through.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shingles import mix, texts

#: Bytes of text that are in numpy at once, unless a line is longer.
PIECE = 1 << 20
BASE = ("email", "ip", "card", "phone")
FOUND = ("name", "secret", "identity")
KINDS = BASE + FOUND
TAGS = ("O", *(f"{p}-{k}" for k in FOUND for p in "BI"))

# patterns: possessive and anchored at the start of a run, so that each character is tried once

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the patterns' matches that hold, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


# the labelled table

_CUES = {
    "name": ("name:", "name is", "Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "signed by", "contact:", "patient:"),
    "secret": ("token =", "token:", "password:", "password =", "secret =", "api_key =", "key =", "passwd:"),
    "identity": ("SSN:", "SSN", "passport:", "passport no.", "ID:", "IBAN:", "IBAN"),
}
_GIVEN = ("Anna", "James", "María", "Jürgen", "Zoë", "Wei", "Fatima", "Luca", "Ingrid", "Pierre")
_FAMILY = ("Smith", "García", "Müller", "Dupont", "O'Neil", "Rossi", "Novak", "Haddad", "Chen", "Berg")


def labelled_words(n: int = 700, seed: int = 7) -> list[tuple[int, int, str, str]]:
    """(sentence, position, word, tag): made-up lines with and without personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    letters = "etaoinshrdlucmfwypvbgkqjxz"

    def filler() -> str:
        kind = rng.random()
        word = "".join(letters[int(26 * rng.random() ** 2)] for _ in range(int(rng.integers(1, 11))))
        if kind < 0.12:
            word = word.capitalize()
        elif kind < 0.16:
            word = word.upper()
        elif kind < 0.22:
            word = str(int(10 ** (rng.random() * 12)))
        elif kind < 0.24:
            word = f"{int(rng.integers(1, 256))}.{int(rng.integers(256))}.{int(rng.integers(256))}.{int(rng.integers(256))}"
        elif kind < 0.26:
            word = f"{word}.{int(rng.integers(99))}@{pick(['mail', 'post'])}{int(rng.integers(9))}.example.com"
        elif kind < 0.28:
            word = f"+1 ({int(rng.integers(100, 999))}) 555-{int(rng.integers(1000, 9999))}"
        elif kind < 0.30:
            word = f"https://{word}.example.org/{word}"
        return word + (pick([".", ",", ";", ":", "!", "###", "|"]) if rng.random() < 0.2 else "")

    def datum(kind: str) -> list[str]:
        if kind == "name":
            return [pick(_GIVEN), pick(_FAMILY)][: 1 + int(rng.random() < 0.8)]
        if kind == "secret":
            abc = pick(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
            x = "".join(abc[int(rng.integers(len(abc)))] for _ in range(int(rng.integers(20, 48))))
            return [pick(['"{}"', "{}", "'{}'"]).format(x)]
        digit = lambda k: "".join(str(int(rng.integers(10))) for _ in range(k))
        return [f"{digit(3)}-{digit(2)}-{digit(4)}"] if rng.random() < 0.6 else [f"{pick(['DE', 'FR', 'ES', 'GB'])}{digit(20)}"]

    out = []
    for s in range(n):
        line: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(1, 4))):
            line += [(w, "O") for _ in range(int(rng.integers(0, 8))) for w in filler().split()]
            if rng.random() < 0.6:
                kind = pick(FOUND)
                line += [(w, "O") for w in pick(_CUES[kind]).split()]
                line += [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(datum(kind))]
                if rng.random() < 0.3:
                    line[-1] = (line[-1][0] + pick([".", ",", ";"]), line[-1][1])
            elif rng.random() < 0.15:  # capitals alone mean nothing
                again = filler().split()[0].capitalize()
                line += [(again if rng.random() < 0.5 else filler().split()[0].capitalize(), "O") for _ in range(int(rng.integers(1, 9)))]
            elif rng.random() < 0.3:  # cues alone mean nothing
                line += [(w, "O") for w in pick(_CUES[pick(FOUND)]).split()]
                line += [(w.lower(), "O") for w in filler().split()]
        out += [(s, i, w, t) for i, (w, t) in enumerate(line)]
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_words(), "sentence long, position long, word string, tag string")


# features: each word has one code in each of these tables

_SHAPES, _CUE_CODES = 2 * 2 * 2 * 2 * 2 * 8 * 2, 64
_CLASS = np.zeros((256, 6), np.int32)  # lower, upper, digit, hyphen, at or slash, other
for _c in range(256):
    _CLASS[_c, 0 if 97 <= _c <= 122 or _c >= 128 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c == 45 else 4 if _c in b"@/" else 5] = 1
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_PACK = (_CLASS * np.array([1, 1 << 8, 1 << 16, 1 << 24, 1 << 32, 1 << 40], np.int64)).sum(axis=1)  # six counters in a word


def _cue_hashes() -> np.ndarray:
    found = sorted({w for cues in _CUES.values() for c in cues for w in c.split()})
    return np.array([_hash_one(w.encode()) for w in found], np.uint64)


def _hash_one(word: bytes) -> int:
    head = int.from_bytes(word[:8].ljust(8, b"\0"), "little")
    return int(mix(np.array([head ^ (len(word) << 56)], np.uint64))[0])


_CUE_LIST = _cue_hashes()
_CUE_SORT = np.argsort(_CUE_LIST)
_CUE_SORTED = _CUE_LIST[_CUE_SORT]
#: Offsets of a word's own codes and of its neighbours' in the weights.
_FIELDS = [(0, "shape"), (0, "cue"), (-1, "shape"), (-1, "cue"), (-2, "cue"), (1, "shape")]
_WIDTH = {"shape": _SHAPES + 1, "cue": _CUE_CODES}
_START = np.cumsum([0] + [_WIDTH[f] for _, f in _FIELDS])


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shape and the cue code of each word of data."""
    size = ends - starts
    digits = np.zeros(len(data) + 1, np.int32)
    counts = []
    for k in (0, 1, 2, 4):
        np.cumsum(_CLASS[data, k], out=digits[1:])
        counts.append(digits[ends] - digits[starts])
    lower, upper, digit, link = counts
    first = data[starts]
    opened = (first == 34) | (first == 39)
    led = np.where(opened & (size > 1), data[np.minimum(starts + 1, ends - 1)], first)
    has_upper = (led >= 65) & (led <= 90)
    hyphens = np.zeros(len(starts), bool)
    if len(data):
        np.cumsum(_CLASS[data, 3], out=digits[1:])
        hyphens = (digits[ends] - digits[starts]) >= 2
    length = np.minimum(7, np.where(size < 4, size, np.where(size < 8, 4, np.where(size < 16, 5, np.where(size < 20, 6, 7))))).astype(np.int64)
    shape = has_upper.astype(np.int64)
    for bit in (lower > 0, upper > 1, digit > 0, link > 0, hyphens):
        shape = shape * 2 + bit
    shape = shape * 8 + length
    # the first eight bytes and the length identify the cues
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.zeros(len(starts), np.uint64)
    for k in range(8):
        head |= np.where(size > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
    head = mix(head ^ (size.astype(np.uint64) << np.uint64(56)))
    at = np.minimum(np.searchsorted(_CUE_SORTED, head), len(_CUE_SORTED) - 1)
    cue = np.where(_CUE_SORTED[at] == head, 1 + np.minimum(_CUE_SORT[at], _CUE_CODES - 2), 0)
    return shape, cue


def features(shape: np.ndarray, cue: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One weight's number for each word and field; neighbours in another line count as none."""
    out = np.empty((len(shape), len(_FIELDS)), np.int32)
    for k, (by, field) in enumerate(_FIELDS):
        codes, none = (shape, _SHAPES) if field == "shape" else (cue, _CUE_CODES - 1)
        moved = np.full(len(codes), none, np.int64)
        if by == 0:
            moved = codes
        elif by < 0 and len(codes) > -by:
            moved[-by:] = np.where(line[-by:] == line[:by], codes[:by], none)
        elif by > 0 and len(codes) > by:
            moved[:-by] = np.where(line[:-by] == line[by:], codes[by:], none)
        out[:, k] = _START[k] + moved
    return out


class Crf:
    """Weights of the features (weight number, tag) and of the steps between tags; tag 0 also stands before a line."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = self.emit[codes[:, 0]].copy()
        for k in range(1, codes.shape[1]):
            out += self.emit[codes[:, k]]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tag of each word, by Viterbi over all lines at once; first: where each line begins."""
        size = np.diff(np.append(first, len(scores)))
        order = np.argsort(-size, kind="stable")
        begin, size = first[order], size[order]
        back = np.zeros(scores.shape, np.int8)
        best = scores[begin] + self.step[0]
        ends = np.zeros((len(begin), scores.shape[1]))
        n = len(begin)
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # lines with more than t words
        for t in range(1, steps + 1):
            m = int(np.searchsorted(-size, -(t + 1), "right")) if t < steps else 0
            if m < n:
                ends[m:n] = best[m:n]
            if not m:
                break
            paths = best[:m, :, None] + self.step[None]
            at = begin[:m] + t
            back[at] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[at]
            n = m
        tags = np.zeros(len(scores), np.int8)
        now = ends.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            m = int(alive[t]) if t < len(alive) else 0
            at = begin[:m] + t
            tags[at] = now[:m]
            now[:m] = back[at, now[:m]] if t else now[:m]
        return tags


def train(rows: list[tuple[int, int, str, str]], *, rounds: int = 100, rate: float = 0.15, decay: float = 2e-3) -> Crf:
    """Maximum likelihood with a quadratic prior, by Adam over the whole labelled table."""
    rows = sorted(rows)
    lines: dict[int, list] = {}
    for s, _, word, tag in rows:
        lines.setdefault(s, []).append((word, tag))
    data = np.frombuffer(b" ".join(w.encode() for line in lines.values() for w, _ in line), np.uint8)
    sizes = np.array([len(w.encode()) for line in lines.values() for w, _ in line])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines.values()])
    codes = features(*word_codes(data, starts, starts + sizes), line)
    gold = np.array([TAGS.index(t) for x in lines.values() for _, t in x])
    k, n, longest = len(TAGS), len(lines), max(map(len, lines.values()))
    slot = np.concatenate([np.arange(len(x)) for x in lines.values()])
    held = np.zeros((n, longest), bool)
    held[line, slot] = True
    emit, step = np.zeros((int(_START[-1]), k)), np.zeros((k, k))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, step)]
    before = np.where(slot > 0, np.roll(gold, 1), 0)
    for r in range(1, rounds + 1):
        flat = Crf(emit, step).scores(codes)
        e = np.zeros((n, longest, k))
        e[line, slot] = flat
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
        alpha[:, 0] = e[:, 0] + step[0]
        for t in range(1, longest):
            new = lse(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
            alpha[:, t] = np.where(held[:, t, None], new, alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = lse(step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(held[:, t + 1, None], new, 0.0)
        one = np.exp(alpha + beta - z[:, None, None])[line, slot]
        want = np.zeros_like(one)
        want[np.arange(len(gold)), gold] = 1
        d_emit, d_step = -decay * emit, -decay * step
        off = (want - one) * (10 / n)
        for f in range(codes.shape[1]):
            for j in range(k):
                d_emit[:, j] += np.bincount(codes[:, f], off[:, j], len(d_emit))
        d_step += np.bincount(before * k + gold, minlength=k * k).reshape(k, k) * (10 / n)
        d_step[0] -= one[slot == 0].sum(axis=0) * 10 / n
        for t in range(1, longest):
            m = held[:, t]
            two = np.exp(alpha[m, t - 1, :, None] + step + (e[m, t] + beta[m, t])[:, None, :] - z[m, None, None])
            d_step -= two.sum(axis=0) * 10 / n
        for w, d, (a, b) in zip((emit, step), (d_emit, d_step), moments, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            w += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-6)
    # steps that tags don't allow
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a[2:] != b[2:]:
                step[i, j] = -1e4
    return Crf(emit, step)


def fitted(labels: DataFrame, *, max_rows: int = 50_000) -> Crf:
    """Trains on the labelled table, or on its first max_rows words by sentence: the documented bound."""
    rows = labels.orderBy("sentence", "position").limit(max_rows).collect()
    return train([tuple(r) for r in rows])


@lru_cache(maxsize=1)
def _strip() -> str:
    return "\"'.,;:()[]{}<>#*$%&|!?"


def crf_spans(model: Crf, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each text of a piece the spans (start, kind, end) that the CRF finds, in code points."""
    ink = _INK[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return {}
    doc = np.searchsorted(bounds, starts, "right") - 1
    line = np.searchsorted(np.flatnonzero(data == 10), starts) + doc * (len(data) + 1)
    codes = features(*word_codes(data, starts, ends), line)
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    tags = model.decode(model.scores(codes), begin)
    hits = np.flatnonzero(tags)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(hits):
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    i = 0
    while i < len(hits):
        j = i
        while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1 and TAGS[tags[hits[j + 1]]][0] == "I":
            j += 1
        w, d = hits[i], doc[hits[i]]
        a, b = starts[w], ends[hits[j]]
        raw = data[a:b].tobytes().decode(errors="replace")
        cut = raw.strip(_strip())
        if cut:
            lead = len(raw) - len(raw.lstrip(_strip()))
            a = int(points[a] - points[bounds[d]]) + lead
            out.setdefault(int(d), []).append((a, KINDS.index(TAGS[tags[w]][2:]), a + len(cut)))
        i = j + 1
    return out


def _segments(raw: np.ndarray, most: int) -> np.ndarray:
    """Where a long text is cut: behind the last line feed within most bytes, or else the next one."""
    feeds, cuts = np.flatnonzero(raw == 10) + 1, [0]
    while len(raw) - cuts[-1] > most:
        k = int(np.searchsorted(feeds, cuts[-1] + most, "right"))
        at = feeds[k - 1] if k and feeds[k - 1] > cuts[-1] else feeds[k] if k < len(feeds) else len(raw)
        if at == len(raw):
            break
        cuts.append(int(at))
    return np.array([*cuts, len(raw)])


def _of_long(model: Crf, raw: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """The CRF's spans of one long text, segment by segment."""
    out, points = [], 0
    cuts = _segments(raw, most)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = raw[a:b]
        out += [(points + s, k, points + e) for s, k, e in crf_spans(model, part, np.array([0, len(part)])).get(0, [])]
        points += int(((part & 0xC0) != 0x80).sum())
    return out


def _merged(base: list, more: list) -> list:
    """base, and of more what overlaps none of base."""
    return sorted(base + [x for x in more if all(x[2] <= b[0] or x[0] >= b[2] for b in base)]) if more else base


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, model: Crf) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, n_spans (those of the CRF too), base_sha256 and spans."""
    added = [*(T.StructField(f"n_{k}", T.LongType()) for k in (*BASE, "spans")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    docs = docs.drop(*(x.name for x in added))
    held = docs.sparkSession.sparkContext.broadcast((model.emit.astype(np.float32), model.step.astype(np.float32)))

    def run(batches):
        crf = Crf(*held.value)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            strings = batch.column("text").to_pylist()
            rows, i = [], 0
            while i < len(strings):
                j = min(len(strings), max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1))
                part = data[offsets[i] : offsets[j]]
                found = crf_spans(crf, part, offsets[i : j + 1] - offsets[i]) if len(part) <= PIECE else {0: _of_long(crf, part, PIECE)}
                for k in range(i, j):
                    base = base_spans(strings[k] or "")
                    counts = [sum(x[1] == c for x in base) for c in range(len(BASE))]
                    every = _merged(base, found.get(k - i, []))
                    rows.append((*counts, len(every), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every)))
                i = j
            columns = [pa.array(x, pa.int64() if n <= len(BASE) else pa.string()) for n, x in enumerate(zip(*rows, strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(x.name for x in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))
