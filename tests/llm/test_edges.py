"""Brute force, odd rows and clashing names, operator by operator."""

import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import containment, crf, divergence, jaccard, line_runs, quotes, suffixes, token_files, warc
from quadrille.llm.queries import tokenizer_file
from tests.llm.test_operators import WORDS, sentence

SF = "/root/testdata/sf0.01"
#: Names that the operators use inside.
CLASH = "doc_id long, text string, lang string, h long, token long, spans string, kept boolean, gone long, n long, th long, w string, runs long, cid long, start long"


def clashing(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, 1, 2, "3", True, 4, 5, 6, "7", 8, 9, 10) for i, t in enumerate(texts)], CLASH)


# quality rules


def test_verdicts_hold_against_labels(spark):
    """Of the labelled documents the bad ones go and the good ones stay; with a filter on the verdict too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = divergence.judge(docs).where("kept").select("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(kept.withColumn("kept", F.lit(1)), "doc_id", "left")
    share = {r.quality: (r.n, r.kept) for r in labels.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.coalesce("kept", F.lit(0))).alias("kept")).collect()}
    assert share[0][1] <= 0.02 * share[0][0] and share[1][1] >= 0.97 * share[1][0], share


def test_a_filter_on_the_verdict_of_long_texts(spark):
    rng = random.Random(1)
    docs = clashing(spark, [sentence(rng, 20_000) for _ in range(6)] + ["x " * 20_000])
    out = divergence.judge(docs).where("kept and n_words > 3").select("doc_id", "h", "gone").collect()
    assert sorted(map(tuple, out)) == [(i, 1, 4) for i in range(6)]


def test_distances_by_hand(spark):
    rng = random.Random(4)
    texts = [sentence(rng, 80) for _ in range(6)] + [" ".join(rng.choice(["zzz", "yyy", "##"]) for _ in range(60))]
    docs = clashing(spark, texts)
    ref = divergence.language_references(docs, n_common=5, min_share=0.01).collect()[0]
    count = defaultdict(int)
    for t in texts:
        for w in t.split():
            count[w] += 1
    total = sum(count.values())
    top = sorted((w for w, n in count.items() if len(w) <= 5 and "," not in w and n >= 0.01 * total), key=lambda w: (-count[w], w))[:5]
    assert ref.words == top and ref.total == total
    assert np.allclose(ref.word_shares, [count[w] / total for w in top] + [1 - sum(count[w] for w in top) / total])

    def distance(p, q):
        m = (p + q) / 2
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return max(0, (kl(p) + kl(q)) / 2) ** 0.5

    for r in divergence.judge(docs, divergence.language_references(docs, n_common=5, min_share=0.01), min_language_words=10).collect():
        words = r.text.split()
        p = np.array([words.count(w) for w in top], float)
        assert r.word_distance == pytest.approx(distance(np.append(p, len(words) - p.sum()) / len(words), np.array(ref.word_shares)), abs=1e-9)


def test_classes_of_every_kind(spark):
    """Counts by hand over characters of all classes, neighbours or apart, and only one regular expression reads whole texts."""
    rng = random.Random(6)
    kinds = ["aéßñжʰ", "AÉÑЖ", "0189", " \t\n\x0b\x0c\r", "#*$%&|<>", "-_.,١\u00a0\u2028ǅ中😀\u0301\x1cª"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(80))) for _ in range(60)] + ["", "".join(kinds), "a" * 99, " \n" * 50, "😀" * 9]
    own = {"lower": lambda c: unicodedata.category(c) == "Ll", "upper": lambda c: unicodedata.category(c) == "Lu", "digit": "0123456789".__contains__}
    own |= {"space": " \t\n\x0b\x0c\r".__contains__, "symbol": "#*$%&|<>".__contains__}
    out = divergence._with_class_counts(spark.createDataFrame([(t,) for t in texts], "__text string"), "c")
    assert out.columns == ["__text", "c"]
    for r in out.collect():
        each = [sum(map(own[c], r["__text"])) for c in divergence.CLASSES[:-1]]
        assert r.c == [*each, len(r["__text"]) - sum(each)], r["__text"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 5 and plan.count("regexp_replace(__text#") == 1, plan


def test_common_words_of_all_lengths(spark):
    """Common words of several bytes a character, the longest one, longer words and words with commas."""
    common = ["né", "жжжжж", "of", "中文"]
    ref = spark.createDataFrame([("en", common, [0.2] * 5, [0.5, 0.1, 0.1, 0.1, 0.1, 0.1], 9999)], "lang string, words array<string>, word_shares array<double>, class_shares array<double>, total long")
    rng = random.Random(7)
    texts = [" ".join(rng.choice([*common, "жжжжжж", "né,of", "n", "offer", ",", "." * 11]) for _ in range(60)) for _ in range(12)]
    out = divergence.judge(clashing(spark, texts), ref)
    for r in out.collect():
        p = np.array([r.text.split().count(w) for w in common], float) / 60
        p, q = np.append(p, 1 - p.sum()), np.full(5, 0.2)
        m = (p + q) / 2
        expected = (sum(x * np.log2(x / y) for a in (p, q) for x, y in zip(a, m, strict=True) if x > 0) / 2) ** 0.5
        assert r.word_distance == pytest.approx(expected, abs=1e-9)


# line dedup


@pytest.mark.parametrize("least", [1, 2, 3])
def test_maximal_runs(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(14)]
    texts += [texts[2] + "\nq\n" + texts[2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, gone = set(), defaultdict(set)
    for i, t in enumerate(texts):
        lines = t.split("\n")
        for k in range(len(lines) - least + 1):
            if tuple(lines[k : k + least]) in seen:
                gone[i] |= set(range(k, k + least))
            seen.add(tuple(lines[k : k + least]))
    want = set()
    for i, at in gone.items():
        for p in at:
            if p - 1 not in at:
                q = p
                while q + 1 in at:
                    q += 1
                want.add((i, p, q - p + 1))
    got = line_runs.maximal_runs(docs, min_lines=least).collect()
    assert {(r.doc_id, r.start, r.n) for r in got} == want and len(got) == len(want)


# suffixes


def test_null_and_large_ids_lose_what_they_share(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(900))
    noise = lambda: "".join(rng.choice("ijklmnop ") for _ in range(300))
    ids = [None, 5, (1 << 53) + 1, None, 7]
    rows = [(d, f"{noise()}{i}{shared}{i}{noise()}") for i, d in enumerate(ids[:4])] + [(7, noise())]
    out = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in out) == [(False, 5, 900), (False, 7, 0), (False, (1 << 53) + 1, 900), (True, 0, 900), (True, 0, 900)]
    for length in (10, 5000):
        with pytest.raises(ValueError, match="bytes"):
            suffixes.window_of(length)


# names that clash


def test_clashing_names(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 40) for _ in range(4)] + [None, ""]
    docs = clashing(spark, [*texts, texts[0]])
    assert suffixes.suffix_dedup(docs).where("doc_id = 0").collect()[0].h == 1
    assert {r.doc_id: r.component for r in jaccard.classes(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}
    bench = spark.createDataFrame([(1, texts[2], 3, "x")], "item_id long, text string, doc_id long, h string")
    assert [(r.doc_id, r.item_id) for r in containment.matches(docs, bench).collect()] == [(2, 1)]
    assert containment.decontaminate(docs, bench).columns == docs.columns
    assert [r.doc_id for r in token_files.round_trip(docs, tokenizer_file("byte_bpe_50k.json")).orderBy("start").collect()] == list(range(7))
    out = line_runs.line_dedup(docs, min_lines=1)
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "n_runs"] and {r.gone for r in out.collect()} == {4}
    assert {(r.doc_id, r.n) for r in crf.find_personal_data(docs, crf.Crf(np.zeros((int(crf._START[-1]), len(crf.TAGS))), np.zeros((len(crf.TAGS),) * 2))).collect()} == {(i, 5) for i in range(7)}


# Jaccard join


def test_a_large_group_of_near_copies_and_its_neighbours(spark):
    """Copies that differ from each other more than the threshold allows, linked by steps; ties and nulls among them."""
    rng = random.Random(12)
    base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((None if i % 10 == 3 else i, " ".join(w)))
    step = list(base)
    for i in range(12):  # a chain that leads away
        for k in range(2):
            step[7 * i % 90 + k] = f"y{i}{k}"
        rows.append((1000 + i, " ".join(step)))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    want = sorted((d is None, d or 0, t, min(least[find(i)], default=None)) for i, (d, t) in enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    th = {r.th: r.text for r in frame.select(F.xxhash64("text").alias("th"), "text").collect()}
    got = sorted((r.doc_id is None, r.doc_id or 0, th[r.th], r.component) for r in jaccard.classes(frame, size=4, num=85).collect())
    assert got == want and len({x[3] for x in want}) > 3


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n, m, both in ((1, 1, 1), (64, 65, 60), (100, 130, 90), (500, 520, 480), (1000, 1100, 300), (33, 32, 0)):
        x = rng.integers(0, 1 << 63, n + m, np.uint64)
        a, b = x[:n], np.concatenate([x[:both], x[n : n + m - both]])
        rows.append((jaccard.sketch(a).tolist(), jaccard.sketch(b).tolist(), n + m - 2 * both))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, d long").select("d", jaccard._differ(F.col("x"), F.col("y")).alias("low"))
    for r in df.collect():
        assert 0 <= r.low <= r.d and (r.d - r.low) % 2 == 0 and r.low > r.d / 5 - 3


# quotes


def test_quotes_against_brute_force(spark):
    rng = random.Random(6)
    say = lambda: f"{sentence(rng, rng.randrange(3, 9)).capitalize()}{rng.choice('.?!')}"
    rows, said = [], defaultdict(list)
    for conv in range(6):
        for turn in range(14):
            lines = []
            for level in (2, 1):
                if said[conv] and rng.random() < 0.6:
                    paragraph = rng.choice(rng.choice(said[conv]))
                    parts = re.split(r"(?<=[.!?])\x20", paragraph)
                    k = rng.randrange(3)
                    text = paragraph if k == 0 else rng.choice(parts) if k == 1 else "never said this. " + rng.choice(parts)
                    words = text.split()
                    cut = rng.randrange(1, len(words) + 1)
                    lines += [f"{'>' * level} " + " ".join(words[:cut])] + ([f"{'>' * level} " + " ".join(words[cut:])] if words[cut:] else []) + [""]
            own = [" ".join(say() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 3))]
            said[conv].append(own or ["Yes."])
            rows.append((conv, turn, "u", "\n".join(lines + ["\n\n".join(own or ["Yes."])])))

    def passages(text):
        out, now = [], None
        for line in text.split("\n"):
            marks = re.match(r"^(?:[ \t]?>)+[ \t]?", line)
            level = marks[0].count(">") if marks else 0
            rest = line[marks.end() :] if marks else line
            if not rest.strip():
                now = None
            elif now is not None and now[0] == level:
                now[1].append(rest)
            else:
                now = [level, [rest]]
                out.append(now)
        return [(level, re.sub(r"\s+", " ", " ".join(x)).lower().strip()) for level, x in out]

    want, first = {}, {}
    for conv, turn, _, text in rows:
        score = defaultdict(lambda: [0, 0])
        for level, p in passages(text):
            if level:
                for whole, units in ((0, [p]), (1, re.split(r"(?<=[.!?…])\x20", p))):
                    for u in units:
                        if first.get((conv, whole, u), turn) < turn:
                            score[level, first[conv, whole, u]][whole] += len(u)
        for level, p in passages(text):
            if not level:
                for whole, units in ((0, [p]), (1, re.split(r"(?<=[.!?…])\x20", p))):
                    for u in units:
                        first.setdefault((conv, whole, u), turn)
        want[conv, turn] = max(score, key=lambda k: (-k[0], *score[k], k[1]))[1] if score else None
    got = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == want and sum(x is not None for x in want.values()) > 20
    for r in got:
        root, depth, at = r.turn, 0, r.turn
        while want[r.conv_id, at] is not None:
            at, depth = want[r.conv_id, at], depth + 1
            root = at
        assert (r.root_turn, r.depth) == (root, depth)


def test_partial_quotes_wrapped_attributions_and_long_messages(spark):
    long = "\n\n".join(f"Paragraph {i} of a long message. It goes on, and on." for i in range(4000))
    rows = [
        (1, 0, "a", "First point. Second point, longer.\n\nThird."),
        (1, 1, "b", "On Monday, the 3rd of May,\nA wrote:\n> Second point, longer.\nYes.\n> First\nno"),
        (1, 2, "c", "On holiday.\n> Yes.\nGood."),
        (2, 0, "a", long),
        (2, 1, "b", "\n".join("> " + x for x in long.split("\n")) + "\nAgreed."),
        (2, 2, "c", "> It goes on, and on.\n> Agreed.\nx"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].body == "Yes.\nno"
    assert got[1, 2].parent_turn == 1 and got[1, 2].body == "On holiday.\nGood."
    assert got[2, 1].parent_turn == 0 and got[2, 1].body == "Agreed." and got[2, 1].n_quotes == 4000
    assert got[2, 2].parent_turn == 0


# personal data: lines written by hand, apart from the generator of the labelled table

HELD_OUT = [
    ("Please forward this to Dr. Olga Petrenko before noon", "name", "Olga Petrenko"),
    ("The patient: Karim Benali was seen twice", "name", "Karim Benali"),
    ("Yours, signed by Harriet Lindqvist", "name", "Harriet Lindqvist"),
    ("contact: Tomás Ibáñez for details", "name", "Tomás Ibáñez"),
    ("Sehr geehrte Frau Hoffmann, vielen Dank", "name", "Hoffmann"),
    ("my name is Priya Raman and I live here", "name", "Priya Raman"),
    ("Monsieur Lefèvre est absent", "name", "Lefèvre"),
    ("export password: Xk29dLq0vPz7TnB4wYc8", "secret", "Xk29dLq0vPz7TnB4wYc8"),
    ("set api_key = 5f2b8c1d9e7a4630b1c2d3e4f5a60718", "secret", "5f2b8c1d9e7a4630b1c2d3e4f5a60718"),
    ('then secret = "ZmFrZVNlY3JldFRva2VuMTIz" and go', "secret", "ZmFrZVNlY3JldFRva2VuMTIz"),
    ("auth token: 9a8b7c6d5e4f3a2b1c0d9e8f in the header", "secret", "9a8b7c6d5e4f3a2b1c0d9e8f"),
    ("his SSN: 219-09-9999 leaked", "identity", "219-09-9999"),
    ("transfer to IBAN: DE44500105175407324931 today", "identity", "DE44500105175407324931"),
    ("passport no. 536-22-8726 expired", "identity", "536-22-8726"),
]
CLEAN = [
    "The quick brown fox jumps over the lazy dog near Berlin",
    "Chapter 12: The Return of the King, by the river",
    "In 1999 the ID of the record was unknown",
    "Use the key to open the door, then sign the name",
    "Version 2.0.1 was released on 2021-03-04",
    "See https://example.org/some/long/path?with=query for more",
]


def test_recall_on_lines_that_no_generator_made():
    field = crf.train(crf.labelled_words())
    spans = lambda t: [(crf.KINDS[k], t[a:b]) for a, k, b in crf.crf_spans(field, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).get(0, [])]
    hit, of = defaultdict(int), defaultdict(int)
    for text, kind, value in HELD_OUT:
        of[kind] += 1
        hit[kind] += (kind, value) in spans(text)
    recall = {k: hit[k] / of[k] for k in of}
    assert recall["secret"] == 1 and recall["identity"] >= 2 / 3 and recall["name"] >= 5 / 7, recall
    assert sum(bool(spans(t)) for t in CLEAN) <= 1


def test_long_texts_are_searched_in_segments(spark, monkeypatch):
    field = crf.train(crf.labelled_words(300))
    text = "\n".join(f"é line {i} password: Xk29dLq0vPz7TnB4wYc{i:04d} end" for i in range(300)) + "\n" + "word " * 400 + 'token = "9a8b7c6d5e4f3a2b1c0d9e8f"'
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    whole = {r.doc_id: r.spans for r in crf.find_personal_data(docs, field).collect()}
    raw = np.frombuffer(text.encode(), np.uint8)
    assert whole[1] == crf.spans_text(crf._of_long(field, raw, 500)) and whole[1].count("secret") == 301 and whole[2] == ""
    assert crf._segments(raw, 500)[0] == 0 and max(np.diff(crf._segments(raw, 500))[:-1]) <= 500
    assert crf._segments(np.frombuffer(b"a" * 50, np.uint8), 7).tolist() == [0, 50]


# archives


def test_damaged_and_padded_archives(spark, tmp_path):
    raw = [warc.record(i, "u", b"x" * 500, "0", None, "2000-01-01T00:00:00Z") for i in range(5)]
    z = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    whole = z.compress(b"".join(raw)) + z.flush()
    member = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    one = member.compress(raw[0]) + member.flush()
    blobs = {"whole": whole, "padded": one + b"\0" * 700 + one + b"\0" * 9, "cut": whole[:-6], "noise": one + b"noise behind it", "empty": b"", "other": zlib.compress(b"x", wbits=31)}
    rows = []
    for name, blob in blobs.items():
        (tmp_path / name).write_bytes(blob)
        rows.append((f"file://{tmp_path}/{name}",))
    out = warc.normalise(spark.createDataFrame(rows, "path string"), f"file://{tmp_path}/out")
    assert sorted((r.n, r.damaged) for r in out.collect()) == [(0, False), (0, True), (1, True), (2, False), (5, False), (5, True)]


def test_null_and_repeated_pages(spark):
    html = "h" * 200
    pages = spark.createDataFrame([(None, "u", html), (4, "u", html), (4, "u", html), (3, "v", html), (9, None, None), (None, "u", "é" * 40_000)], "page_id long, url string, html string")
    got = sorted(((r.page_id is None, r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived(pages).collect())
    assert got == [((False, 3), "response", None, 200), ((False, 4), "revisit", 3, 200), ((False, 4), "revisit", 3, 200), ((False, 9), "response", None, 0), ((True, 0), "response", None, 80_000), ((True, 0), "revisit", 3, 200)]
    ids = {warc.header(warc.record(1, "u", b"", "0", None, "d")[:-4].split(b"\r\n\r\n")[0])["WARC-Record-ID"] for _ in range(3)}
    assert len(ids) == 3


# the pipeline


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    texts = [sentence(rng, 60) for _ in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines string, n_words string, th string, n string, item_id string, label string"
    more = ("a", "b", "c", "d", "e", "f", "g")
    rows = [(i, t, "en", "s", len(t), *more) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, *more), (7, None, None, None, None, *more), (7, "", "en", "s", 0, *more), (2, texts[2], "en", "s", len(texts[2]), *more)]
    spark.createDataFrame([(1, " ".join(texts[4].split()[5:30])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    want = {"quality rules": 7, "line dedup": 8, "n-gram Jaccard join": 7, "benchmark decontamination": 8, "SentencePiece encoding and decoding": 9}
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and out.schema[0].dataType == docs.schema[0].dataType
        found = out.collect()
        left[name] = len(found)
        assert {tuple(r[5:12]) for r in found} == {more}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert left == want
