"""Spelling variants, toxic spans and the divergence of sources, against brute force and SQL."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, letters, spelling, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- spelling variants


def variants_by_hand(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    forms = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        top = min(around, key=lambda v: (-n[v], v), default=None)
        forms[w] = (top if top and n[top] >= 2 * n[w] else None, len(around))
    out = []
    for w in sorted(n):
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n[w], forms[w][1], n[form] if form else None))
    return out


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = np.random.default_rng(5)
    stems = ["colour", "colouur", "letter", "leter", "lettter", "aaaaa", "aaaaaa", "aaaaaaa", "élève", "élèves", "élèvés", "ÀÀÀÀÀ", "banana", "bananas", "banan", "bbanana"]
    words = stems * 4 + ["colour"] * 40 + ["élève"] * 9 + ["short", "shor", "x×y÷zzz"] * 3
    for stem in stems:
        for _ in range(6):
            k = int(rng.integers(len(stem)))
            words += [stem[:k] + "abé"[int(rng.integers(3))] + stem[k + int(rng.integers(2)) :]] * int(rng.integers(1, 7))
    rng.shuffle(words)
    rows = [(k, ", ".join(words[k::9]).title() if k % 3 else " ".join(words[k::9]), "en", "s", 0) for k in range(9)]
    rows += [rows[0], (None, "colour Colour; leter1letter", None, None, None), (50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "q" * 7_000 + " " + "q" * 6_999 + "r", "en", "s", 0)] + [(53, "q" * 7_000 + " " + "q" * 6_999 + "r", "en", "s", 0)] * 3
    return rows


@pytest.mark.parametrize("options", [{}, {"key_words": 2, "task_words": 20}])
def test_variants_equal_brute_force(spark, misspelt, options):
    rows = misspelt if not options else misspelt[:-4]  # the long words once
    got = rows_of(spelling.variants(spark.createDataFrame(rows, SCHEMA), **options), "word")
    assert sorted(got) == sorted(variants_by_hand(rows)) and any(r[1] for r in got)
    if options:
        assert len({r[2] for r in got if r[1] and r[1] != r[2]}) > 0  # a form has a form of its own


def test_checksums_go_on_from_their_seeds():
    words = [b"", b"a", b"Hello", b"x" * 64, b"y" * 65, b"z" * 300]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    seeds = np.array([zlib.crc32(f"{k}:".encode()) for k in range(6)], np.uint32)
    got = spelling.checksums(seeds, data, end - [len(w) for w in words], end)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + w.lower()) for k, w in enumerate(words)]


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("", "un", "re") for b in ("do", "tie", "pack") for c in ("", "s", "ing")})
    automaton = spelling.Automaton([w.encode() for w in words])
    for number, word in enumerate(words):
        state, place = np.array([automaton.start]), np.array([0])
        for char in word.encode():
            ok, edge = automaton.step(state, np.array([char]))
            state, place = automaton.next[edge], place[ok] + automaton.skip[edge]
        assert automaton.final[state[0]] and place[0] == number
    # states are as many as there are sets of endings
    assert len(automaton.final) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for word in words for p in (word[:k] for k in range(len(word) + 1))})


def test_spelling_of_odd_documents(spark, odd_documents, no_documents):
    assert spelling.variants(no_documents).collect() == []
    assert {r["word"] for r in spelling.variants(odd_documents).collect()} == set()


# --- divergence of sources


@pytest.fixture(scope="module")
def sources():
    rng, rows = np.random.default_rng(3), []
    terms = ["alpha", "Beta", "gámma", "δέλτα", "eps"] + [f"w{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(26)]
    for k in range(400):
        lang, source = (None, "en", "de")[min(k % 5, 2)], [None, "", "a", "b", "c", "d", "e", "f", "g", "hot"][min(int(rng.integers(16)), 9)]
        few = rng.integers(0, len(terms) if source == "hot" else 8, rng.integers(0, 30))
        rows.append((k // 2, " 1-".join(terms[j] for j in few), lang, source, 0))
    return rows + [(1, None, "en", "empty", 0), (1, "alpha", "fr", "x", 0), (1, "beta", "fr", "y", 0), (1, None, "it", "alone", 0)]


def by_sql(rows, sql):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return c.sql(sql).fetchall()


@pytest.mark.parametrize("side, share", [(256, 4), (3, 4), (3, 1), (256, 1), (4, 10**6)])
def test_audit_equals_sql(spark, sources, side, share):
    got = divergence.audit(spark.createDataFrame(sources, SCHEMA), dense_share=share, width=side, block_terms=7)
    names = ["lang", "source", "part", "item", "value", "rank"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(by_sql(sources, divergence.AUDIT_SQL))


def test_audit_by_hand_with_counts_beyond_64_bits():
    # 1 + floor(10^9 (n + 5) / (N + 5 V)) where the product does not fit into 64 bits
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7), (0, 0, 3), (5, 100, 0)], "n long, whole long, kept long")
    got = [r[0] for r in df.select(divergence._price(F.col("n"), F.col("whole"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35), 1 + 10**9 * 5 // 15, None]


def test_audit_of_odd_documents(spark, odd_documents, no_documents):
    assert divergence.audit(no_documents).collect() == []
    got = divergence.audit(odd_documents, min_documents=2).collect()
    assert {(r["source"], r["item"]) for r in got if r["part"] == "pair" and r["lang"] == "en"} == {(a, b) for a in ("", "s", "t") for b in ("", "s", "t") if a != b}


def test_letters_of_a_column():
    import pyarrow as pa

    texts = ["Ab-cÉ", None, "", "ÀÁ1漢字x", "no end"]
    for mask, pattern in ((letters.latin_mask, "[A-Za-zÀ-ÿ]+"), (letters.wide_mask, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+")):
        found = defaultdict(list)
        for s in letters.stretches(pa.array(texts), mask, 4):
            for t, word in zip(s.text, letters.strings(s.data, s.start, s.end).to_pylist()):
                found[s.first + int(t)].append(word)
        assert dict(found) == {k: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(pattern, t)] for k, t in enumerate(texts) if re.findall(pattern, t or "")}


# --- toxic spans


@pytest.fixture(scope="module")
def toxic_documents(spark):
    rng = np.random.default_rng(11)
    clean = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("rin", "sol", "tam", "vex", "dul")]
    bad = ["grumb", "snark", "voltz"]
    rows, labels = [], []
    for k in range(600):
        words, toxic = [clean[j] for j in rng.integers(0, len(clean), 60)], k % 4 == 0
        for _ in range(4 if toxic else 0):
            words[int(rng.integers(60))] = bad[int(rng.integers(3))] + clean[int(rng.integers(25))]
        rows.append((k, ". ".join(words).title(), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxic_spans_of_held_out_documents(toxic_documents):
    docs, labels = toxic_documents
    got = toxicity.toxic_spans(docs, labels).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.98 * len(held)
    for r in held:
        marked = {(x["start"], x["end"]) for x in r["spans"]}
        meant = {m.span() for m in re.finditer("[^\\W\\d_]+", r["text"]) if re.match("grumb|snark|voltz", m.group().lower())}
        covered = [any(a <= m[0] and m[1] <= b for a, b in marked) for m in meant]
        assert sum(covered) >= 0.75 * len(meant) and all(any(m[0] < b and a < m[1] for m in meant) for a, b in marked)


def marginals_by_hand(e, start, steps):
    """All ways of tagging the tokens, weighed."""
    n, out, whole = len(e), np.zeros(len(e)), 0.0
    for code in range(1 << n):
        tags = [code >> k & 1 for k in range(n)]
        w = np.exp(start[tags[0]] + sum(steps[a][b] for a, b in zip(tags, tags[1:])) + sum(x for x, t in zip(e, tags) if t))
        whole += w
        out += w * np.array(tags)
    return out / whole


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    weights, ids = np.zeros(toxicity.BUCKETS), None
    import pyarrow as pa

    texts = ["ab cd ef gh", "xy", "", "gh gh ab zz yy xx ww", None, "cd"]
    [s] = list(letters.stretches(pa.array(texts), letters.wide_mask))
    words = toxicity.Words.of(s)
    ids = toxicity.buckets(words.parts())
    weights[ids.ravel()] = rng.normal(size=ids.size)
    start, steps = rng.normal(size=2), rng.normal(size=(2, 2))
    got = toxicity.Field(weights, start, steps, np.zeros(4)).marginals(words, s.text)
    for t in set(s.text.tolist()):
        mine = np.flatnonzero(s.text == t)
        w = words.token[mine]
        e = weights[ids[w, :-2]].sum(axis=1)
        e[1:] += weights[ids[w[:-1], -2]]
        e[:-1] += weights[ids[w[1:], -1]]
        assert np.allclose(got[mine], marginals_by_hand(e, start, steps))


def test_fitted_field_expects_what_the_labels_say():
    # at the optimum, toxic tokens are expected as often as labelled, over all and of each word
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["xx", "yy"], n)) for n in (5, 9, 64, 64, 30, 1)]
    [s] = list(letters.stretches(pa.array(texts), letters.wide_mask))
    words = toxicity.Words.of(s)
    labels = (rng.random(len(s.text)) < np.where(words.token == 0, 0.2, 0.6)).astype(np.int8)
    field = toxicity.fit(words, s.text, labels, steps=600, rate=0.03, penalty=1e-4)
    p = field.marginals(words, s.text)
    for k in (0, 1):
        assert abs(p[words.token == k].sum() - labels[words.token == k].sum()) < 0.5


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents, labels, toxic_documents):
    assert toxicity.toxic_spans(no_documents, labels).collect() == []
    for known in (labels, labels.limit(0)):
        got = toxicity.toxic_spans(odd_documents, known).collect()
        assert len(got) == odd_documents.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 and r["spans"] == [] for r in got)
    field = toxicity.train(*toxic_documents)
    got = toxicity.toxic_spans(odd_documents, labels, field).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (2, 3, 7)}) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]


# --- packing plans on length mixes that are hard in different ways


@pytest.mark.parametrize("low, high", [(700, 1400), (500, 900), (420, 760), (300, 1200), (1, 2049)])
def test_plans_are_never_worse_than_best_fit(low, high):
    from lodestone.llm import packing

    lengths = np.random.default_rng(low).integers(low, high, 4000)
    counts = np.bincount(lengths - 1, minlength=2048)
    plan = packing.pack_plan(counts)
    used = np.zeros(2048, np.int64)
    for config, times in plan:
        assert sum(n * k for n, k in config) <= 2048
        for n, k in config:
            used[n - 1] += k * times
    assert (used == counts).all()
    size = lambda p: sum(times for _, times in p)
    bound = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert bound <= size(plan) <= size(packing.best_fit(counts, 2048))
