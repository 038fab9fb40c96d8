"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import components, containment, crf, divergence, jaccard, line_runs, maxplus, quotes, shingles, suffixes, token_files, warc
from quadrille.llm.queries import tokenizer_file

WORDS = "the of and to in is that for was on with as be by are this at it from or an were which you".split()
SCHEMA = "doc_id long, text string, lang string, n long, spans string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", str(rng.randrange(30))]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    lines = [sentence(rng, rng.randrange(1, 9)) for _ in range(25)]
    base = [sentence(rng, rng.randrange(5, 90)) for _ in range(12)]
    out = [None, "", " ", "one", "Ünï çødé 😀 " * 9, "x " * 300, "a b c", "\n\n", "word\n\nword\n\nword\n\nword"]
    for _ in range(70):
        kind = rng.randrange(4)
        words = rng.choice(base).split()
        if kind == 0 and len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        if kind == 1:
            text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))
        elif kind == 2:
            text = text + " " + rng.choice(base)
        out.append(text)
    return out + out[-3:] + [" ".join(base)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "de"][i % 3], i, "mine") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[12], rows[13]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


# quality rules


def base(text):
    text = text or ""
    words = split(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split(x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(docs, none, texts):
    junk = ["# " + t.replace(" ", " ### $$$ ") for t in texts[20:24] if t]
    more = docs.unionByName(docs.sparkSession.createDataFrame([(1000 + i, t, "en", 0, "") for i, t in enumerate(junk)], SCHEMA))
    out = divergence.judge(more, min_words=20, min_language_words=100)
    assert out.columns[:5] == docs.columns
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r.text
        assert not (r.kept and r.base_failed)
        if r.n_words < 20:
            assert r.class_distance is None and r.kept == (not r.base_failed)
        if r.doc_id >= 1000 and r.n_words >= 20:
            assert r.class_distance > 0.28 and not r.kept
    assert divergence.judge(none).count() == 0


def test_jensen_shannon(spark):
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    got = spark.range(1).select(divergence.jensen_shannon(F.lit(p.tolist()), F.lit(q.tolist()))).collect()[0][0]
    assert abs(got - ((kl(p) + kl(q)) / 2) ** 0.5) < 1e-12


# line dedup


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup(docs, none, texts, least):
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    seen, gone = set(), set()
    for i, text in sorted(rows, key=lambda x: x[0]):
        ink = [k for k, x in enumerate((text or "").split("\n")) if split(x)]
        lines = [(text or "").split("\n")[k] for k in ink]
        for k in range(len(lines) - least + 1):
            gram = tuple(lines[k : k + least])
            if gram in seen:
                gone |= {(i, ink[k + j]) for j in range(least)}
            seen.add(gram)
    out = line_runs.line_dedup(docs, min_lines=least).collect()
    assert len(out) == docs.count()
    for r in out:
        text = texts[r.doc_id]
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == want, (r.doc_id, least)
        assert r.n_removed == sum(d == r.doc_id for d, _ in gone)
    assert line_runs.line_dedup(none).count() == 0


def test_long_single_lines(spark):
    long, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd\n{short}"), (3, f"{long}\n\n{long}\ne"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: f"c\nd\n{short}", 3: "\ne", 4: ""}
    assert {r.doc_id: r.text for r in line_runs.line_dedup(docs, min_words=50).collect()} == want
    cut = __import__("corpus_pipeline").line_dedup(spark, docs, "")
    assert {r.doc_id: r.text for r in cut.collect()} == {k: t for k, t in want.items() if k != 4}


# Jaccard join


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(docs, none, texts, size, num):
    def grams(text):
        w = [x.lower() for x in split(text)]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    reach = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= num * len(a | b) and reach[j] < reach[i]:
                    reach[i], changed = reach[j], True
    for r in jaccard.classes(docs, size=size, num=num).collect():
        assert (r.n, r.component) == (len(sets[r.doc_id]), reach[r.doc_id]), texts[r.doc_id]
    assert jaccard.classes(none).count() == 0


def test_shingle_sets_tell_texts_apart():
    cases = ["a b c d", "A B C D", "a b c d e", "ab c d", "a  b\tc\nd", None, "", "a b", "b a", "é b c d"]
    got = [x.tolist() for x in shingles.shingle_sets(pa.array(cases), 4)]
    assert got[0] == got[1] == got[4] and got[5] == got[6] == []
    assert len({tuple(x) for x in got}) == 7


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert dict(map(tuple, components.connected(links).collect())) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# containment


def test_containment(spark, docs, none, texts):
    rng = random.Random(3)
    items = [" ".join((texts[i] or "").split()[:k]) for i, k in ((12, 30), (15, 12), (20, 5), (22, 3), (25, 1))] + [None, " ", sentence(rng, 25)]
    items[0] = items[0].replace(" ", " extra ", 1)
    bench = spark.createDataFrame([*enumerate(items), (1, items[1])], "item_id long, text string")

    def grams(text, k):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for i, t in enumerate(texts):
        for j, x in enumerate(items):
            k = min(5, len((x or "").split()))
            if k and 100 * len(grams(t, k) & grams(x, k)) >= 80 * len(grams(x, k)):
                want[i, j] = (len(grams(t, k) & grams(x, k)), len(grams(x, k)))
    got = containment.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
    left = {r.doc_id for r in containment.decontaminate(docs, bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}
    assert containment.matches(none, bench).count() == containment.matches(docs, bench.limit(0)).count() == 0


# suffixes


@pytest.mark.parametrize(("length", "hot"), [(40, 50_000), (60, 50_000), (200, 50_000), (60, 4), (200, 2)])
def test_suffix_dedup(docs, none, texts, length, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "RUN", 200)
    monkeypatch.setattr(suffixes, "RANGE", 100)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    want = Counter()
    for d, t in rows:
        mask = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        spans = sum(x and not (i and mask[i - 1]) for i, x in enumerate(mask))
        want[d, len(t), sum(mask), spans, bytes(b for b, x in zip(t, mask, strict=True) if not x)] += 1
    got = suffixes.suffix_dedup(docs, length=length)
    assert got.columns[:5] == docs.columns
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want
    assert sum(x[2] for x in want) > 0 and suffixes.suffix_dedup(none).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))), bytes([k]), False) for _ in range(rng.randrange(1, 40))) for k in range(5)]
    out = list(suffixes.merged([suffixes.front_coded(r) for r in runs]))
    assert sorted(x[1] for x in out) == [x[1] for x in out] and Counter(x[1:] for x in out) == Counter(e for r in runs for e in r)
    for (_, a, _, _), (k, b, _, _) in zip(out, out[1:], strict=False):
        assert k == suffixes.common_prefix(a, b)


def test_anchors_of_a_text_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(900)
    text = noise(70_000) + passage + noise(500) + passage
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 12)
    got = suffixes.suffix_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (got.n_removed, got.n_spans) == (1800, 2)


# archives


def test_archives(spark, texts):
    rows = [(i, f"http://x/{i}\r\nInjected: 1" if i % 5 else None, t, "mine") for i, t in enumerate(texts)]
    pages = spark.createDataFrame([*rows, rows[30], (500, "u", "y" * 99, ""), (501, "u", "y" * 99, ""), (503, "u", "z" * 100, ""), (502, "u", "z" * 100, "")], "page_id long, url string, html string, digest string")
    all_rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, t in all_rows:
        first[t] = min(i, first.get(t, i))
    want = Counter()
    for i, t in all_rows:
        again = len(t) >= 100 and first[t] != i
        want[i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if again else "response", first[t] if again else None] += 1
    assert Counter(map(tuple, warc.archived(pages).collect())) == want
    assert warc.archived(pages.limit(0)).count() == 0


def test_normaliser_reads_any_gzip(tmp_path):
    raw = [warc.record(i, "u", b"x" * (3_000_000 if i == 1 else i), "0", None if i % 2 else 7, "2000-01-01T00:00:00Z") for i in range(4)]
    whole = zlib.compressobj(1, zlib.DEFLATED, warc.GZIP)
    blob = whole.compress(b"".join(raw[:2])) + whole.flush()
    for r in raw[2:]:
        z = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
        blob += z.compress(r) + z.flush()
    (tmp_path / "a").write_bytes(blob)
    with open(tmp_path / "a", "rb") as f:
        assert [r for _, r in warc.records(warc.inflated(f))] == raw


# tokens


def test_token_files(spark, docs, none, texts):
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(file)
    odd = ["it's  'll 've", " a  b", "a\t b\n c ", "x\r\n y", "wörd,, #*# 12 34", "²³ ½x a² b", "a b   c", "<|endoftext|> x"]
    more = docs.unionByName(spark.createDataFrame([(2000 + i, t, None, 0, "") for i, t in enumerate(odd)], SCHEMA))
    at, want = 0, Counter()
    for i, t in sorted(((r.doc_id, r.text or "") for r in more.collect())):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    where = token_files.shared_dir(spark)
    files = token_files.write(more, where, file, length=16, rows=4)
    assert Counter(map(tuple, token_files.read(files).collect())) == want
    total = 0
    for path in [r.path for r in files.collect()]:
        table = token_files.sequences(path)
        assert table["ids"].type.list_size == 16
        total += sum(x for m in table["mask"].to_pylist() for x in m)
    assert total == at and token_files.round_trip(none, file).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return tokenizer_file("piece_bpe_32k.model")


def test_best_paths_equal_the_library(model, texts):
    import sentencepiece

    raw = open(model, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")  # the model's kind, made unigram
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x12\x06tok_v0\x18\x01" + raw[at + 10 :])
    pieces = maxplus.Pieces(model)
    score = lambda ids: sum(sp.get_score(int(i)) for i in ids if not sp.is_byte(int(i)))
    for text in [" ".join(t.split())[:50].strip() for t in texts if t and t.strip()]:
        ids = np.frombuffer(pieces.encode([text])[0], "<i4").tolist()
        best = sp.nbest_encode(text, nbest_size=2)[0]
        assert score(ids) == score(best), text


def test_chunks_give_the_ids_of_the_whole(model, texts):
    """Also where many segmentations are equally good: aaaa as aa a a, a aa a and so on."""
    pieces, rng = maxplus.Pieces(model), random.Random(1)
    equal = maxplus.Pieces(model)
    equal.score = {p: (-(1 << 24) * len(p) << maxplus.TIE_BITS, i) for p, (_, i) in equal.score.items()}
    for k in range(120):
        pieces, equal = equal, pieces
        text = (rng.choice(texts[20:]) or "x")[:400]
        text = "".join(rng.choice("aae ") for _ in range(90)) if k % 3 == 0 else text.replace(" ", "") if k % 4 == 0 else text.replace("er", " \n  ") if k % 5 == 0 else text
        size, s = rng.choice([2, 7, 20, 90]), maxplus.SPACE + text.replace(" ", maxplus.SPACE)
        starts = [i for i in range(len(s)) if i == 0 or s[i] == maxplus.SPACE != s[i - 1]]
        parts = [(s[a : a + size + pieces.longest - 1], min(size, len(s) - a), a - max(x for x in starts if x <= a)) for a in range(0, len(s), size)]
        matrices = [pieces.matrix(*p) for p in parts]
        product = matrices[0]
        for m in matrices[1:]:
            product = maxplus.combine(product, m)
        best = sum(map(pieces.best, pieces.cut(text)))
        assert (int(product[0, 0, 0]), int(product[1, 0, 0])) == (best >> maxplus.TIE_BITS, best & ((1 << maxplus.TIE_BITS) - 1))
        # states as the levels find them
        reach = [(np.where(np.arange(pieces.longest) == 0, 0, maxplus.LOW), np.zeros(pieces.longest, np.int64))]
        for m in matrices:
            reach.append(maxplus._greatest(reach[-1][0][:, None] + m[0], reach[-1][1][:, None] + m[1], 0))
        states = [0]
        for m, (score, ties) in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
            states.append(int(np.lexsort((ties + m[1][:, states[-1]], score + m[0][:, states[-1]]))[-1]))
        states.reverse()
        ids = b"".join(pieces.pieces(*p, a, b) for p, a, b in zip(parts, states[:-1], states[1:], strict=True))
        assert ids == pieces.encode([text])[0], (text, size)


@pytest.mark.parametrize("chunk", [7, 60])
def test_scanned_texts_get_the_ids_of_whole_ones(spark, model, texts, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(maxplus, "FAN", 3)
    raw = open(model, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    (tmp_path / "m").write_bytes(raw[: at + 9] + b"\x01" + raw[at + 10 :])
    rng = random.Random(chunk)
    rows = [(i, "".join(rng.choice("aae ") for _ in range(rng.randrange(9, 200)))) for i in range(12)] + [(100 + i, t) for i, t in enumerate(texts[:25])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole, parts = ({r.doc_id: r.ids for r in maxplus.encode(frame, str(tmp_path / "m"), chunk=c).collect()} for c in (1 << 15, chunk))
    assert whole == parts and len(whole) == len(rows)


def test_encoding_round_trip(spark, docs, none, texts, model, monkeypatch):
    monkeypatch.setattr(maxplus, "FAN", 3)
    odd = [(3000 + i, t, "x", 0, "") for i, t in enumerate(["  lead", "trail  ", "a" * 700, "😀" * 300, "tab\tnew\nline " * 60])]
    more = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    whole = {(r.doc_id, r.text): r.ids for r in maxplus.encode(more, model).collect()}
    out = maxplus.decode(maxplus.encode(more, model, chunk=60), model)
    assert out.columns == [*docs.columns, "ids", "decoded"] and out.count() == more.count()
    for r in out.collect():
        assert r.decoded == r.text and r.ids == whole[r.doc_id, r.text], r.text
    assert maxplus.encode(none, model).count() == 0


def test_encoding_and_decoding_share_a_worker(spark, docs, model, tmp_path):
    """A task that encodes and decodes has one Python worker; the rows are those of encode and decode apart."""
    from quadrille.llm.queries import op6_maxplus

    rows = [(1, "two words"), (2, ""), (3, None), (None, "  x\u2581y "), (5, "z" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = op6_maxplus(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("decoded", F.lit(1))
    for chunk in (60, 1 << 15):
        apart = maxplus.decode(maxplus.encode(more, model, chunk=chunk), model)
        once = maxplus.encode(more, model, chunk=chunk, decoded=True)
        assert once.columns == ["doc_id", "text", "ids", "decoded"]
        assert sorted(map(repr, once.collect())) == sorted(map(repr, apart.select(*once.columns).collect()))


def test_ids_are_those_of_the_unmodified_model(spark, docs, texts, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = ["Elle est", "  lead", "trail  ", " ", "a" * 700, "😀" * 300, "tab\tnew\nline " * 60, "a▁b▁▁", "(x).,; \x00 1234" * 30, "她 说过" * 90, "a   b" * 50]
    more = docs.unionByName(spark.createDataFrame([(3000 + i, t, "x", 0, "") for i, t in enumerate(odd)], SCHEMA))
    for chunk in (60, 1 << 15):
        for r in maxplus.encode(more, model, chunk=chunk).collect():
            assert r.ids == (None if r.text is None else sp.encode(r.text)), (chunk, r.text)


@pytest.mark.parametrize("kind", [1, 2])
def test_giants_without_doc_id_keep_their_rows(spark, model, tmp_path, kind):
    raw = open(model, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    (tmp_path / "m").write_bytes(raw[: at + 9] + bytes([kind]) + raw[at + 10 :])
    giant = "mine and yours " * 20
    rows = [(None, giant), (None, giant), (None, giant + "x"), (0, giant), (0, giant + "y"), (None, "short"), (None, None), (1, giant)]
    ids = {}
    for chunk in (60, 1 << 15):
        out = maxplus.encode(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "m"), chunk=chunk).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
        for r in out:
            assert ids.setdefault(r.text, r.ids) == r.ids and (r.ids is None) == (r.text is None)


# personal data


@pytest.fixture(scope="module")
def field():
    return crf.train(crf.labelled_words())


def test_field_on_held_out_lines(field):
    lines = {}
    for s, _, w, t in crf.labelled_words(300, seed=77):
        lines.setdefault(s, []).append((w, t))
    found = wanted = right = 0
    for line in lines.values():
        data = np.frombuffer(" ".join(w for w, _ in line).encode(), np.uint8)
        got = {(a, k) for a, k, _ in crf.crf_spans(field, data, np.array([0, len(data)])).get(0, [])} if len(data) else set()
        at, want = 0, set()
        for w, t in line:
            if t[0] == "B":
                want.add((len(" ".join(x for x, _ in line)[:at]) + len(w) - len(w.lstrip("\"'")), crf.KINDS.index(t[2:])))
            at += len(w) + 1
        found, wanted, right = found + len(got), wanted + len(want), right + len(got & want)
    assert right / found > 0.95 and right / wanted > 0.95


def test_viterbi_equals_all_paths(field):
    from itertools import product

    rng = np.random.default_rng(0)
    scores, first = rng.normal(size=(9, len(crf.TAGS))), np.array([0, 4, 5])
    model = crf.Crf(field.emit, rng.normal(size=field.step.shape))
    got = model.decode(scores, first)
    for a, b in ((0, 4), (4, 5), (5, 9)):
        value = lambda p, a=a: sum(scores[a + i, t] + model.step[p[i - 1] if i else 0, t] for i, t in enumerate(p))
        best = max(product(range(len(crf.TAGS)), repeat=b - a), key=value)
        assert tuple(got[a:b]) == best


def test_personal_data(spark, docs, none, field):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def spans(text):
        out = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 12 <= len(d) <= 19 and sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2]) and (sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0:
                out.append((m.start(), 2, m.end()))
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15])

    rng, odd = random.Random(4), ["é a.b@c.d é 1.2.3.4.5.6.7.8", "@@ .@a.b", "4111 1111 1111 1111 +1 (555) 123-4567 999.1.1.1", 'x token = "9f86d081884c7d659a2feaa0c55ad015" y', "+1+1 (((22 33 44 55 66"]
    odd += ["".join(rng.choice("@.-+1 29a(") for _ in range(60)) for _ in range(150)]
    more = docs.unionByName(spark.createDataFrame([(4000 + i, t, None, 0, "") for i, t in enumerate(odd)], SCHEMA)).drop("n")
    out = crf.find_personal_data(more, field)
    for r in out.collect():
        want = spans(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in want) for k in range(4)), r.text
        assert r.base_sha256 == hashlib.sha256(crf.spans_text(want).encode()).hexdigest()
        assert {crf.spans_text([x]) for x in want} <= set(r.spans.split(","))
        if r.doc_id == 4003:
            assert r.spans == "secret:11:43"
    assert crf.find_personal_data(none, field).count() == 0


# quotes


def test_quote_links(spark):
    rows = [
        (1, 0, "a", "Hello all,\n\nWhich plan\nis best?", "x"),
        (1, 1, "b", "On Monday, A wrote:\n> Which plan is\n> best?\n\nThe second.", "x"),
        (1, 2, "c", ">> Which plan is best?\n> The second.\nNo, the third!", "x"),
        (1, 3, "d", "> No, the third!\r\nWhy?", "x"),
        (1, 4, "e", "> never said\nok", "x"),
        (1, 5, "f", None, "x"),
        (2, 0, "a", "> Which plan is best?\nno", "x"),
        (2, 1, "a", "", "x"),
        (2, 1, "a", "", "x"),
        (None, 1, "a", "Why?", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent string")
    out = quotes.linked_conversations(df)
    got = {(r.conv_id, r.turn): (r.n_quotes, r.parent_turn, r.root_turn, r.depth, r.body) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, 0] == (0, None, 0, 0, "Hello all,\n\nWhich plan\nis best?")
    assert got[1, 1] == (1, 0, 0, 1, "The second.")
    assert got[1, 2] == (2, 1, 0, 2, "No, the third!")
    assert got[1, 3] == (1, 2, 0, 3, "Why?")
    assert got[1, 4] == (1, None, 4, 0, "ok") and got[1, 5] == (0, None, 5, 0, "")
    assert got[2, 0] == (1, None, 0, 0, "no")
    assert quotes.linked_conversations(df.limit(0)).count() == 0


# the pipeline


def test_null_and_repeated_doc_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d, e = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcde")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")

    # stage 2: the null doc_id comes first, its later copies and its own go like others
    two = frame([(None, "x y\nz w\nq", "en"), (None, "p\nx y\nz w", "en"), (7, "x y\nz w\nr", "en")])
    cut = [(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, two, "").collect()]
    assert len(cut) == 3 and sum(t.count("x y\nz w") for _, t in cut) == 1 and (7, "r") in cut

    # stage 3: one of repeated rows, the clean text beside a copy under one doc_id, near copies without doc_id
    rows = [(1, a, "en"), (1, a, "de"), (2, a + " more", "en"), (2, b, "en"), (3, c, "en"), (None, c + " end", "en"), (None, d, "en"), (None, d + " end", "en"), (4, e, "en"), (4, e + " end", "en")]
    got = [tuple(r) for r in corpus_pipeline.ngram_jaccard_join(spark, frame(rows), "").collect()]
    assert [r[1] for r in got].count(a) == 1 and (1, a, "de") in got and (2, b, "en") in got and (3, c, "en") in got
    assert len(got) == 5 and sum(r[0] is None and r[1].startswith(d) for r in got) == 1 and sum(r[0] == 4 for r in got) == 1

    # stage 4: a contaminated null doc_id goes, a clean one stays
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.benchmark_decontamination(spark, frame([(None, a + " x", "en"), (None, b, "en"), (5, a, "en")]), str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(None, b, "en")]
    assert containment.matches(frame([(None, a, "en")]), spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 1


def test_pipeline_stages(spark, tmp_path, texts):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [sentence(rng, 60) for _ in range(20)]
    item = " ".join(clean[5].split()[10:40])
    near = clean[3].replace(" ", " changed ", 1)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*clean, clean[2], near, "junk " * 50, sentence(rng, 40) + " " + item])] + [(900, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the copy, the near copy, the junk, both holders of the item and the null text go
    assert sorted(r.doc_id for r in out) == [i for i in range(20) if i != 5]
    assert all(r.ids for r in out) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
