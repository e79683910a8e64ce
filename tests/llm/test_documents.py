"""Operators on documents: odd rows, brute force, planted cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import components as K
from lodestone.llm import jaccard, lm, mixing, packing, passages, rules, textvec
from lodestone.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
VOCABULARY = [f"word{i}" for i in range(3000)]


def prose(seed, n):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long")


# word hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0b\x1cé漢", max_size=30)), max_size=8))
def test_words_of_arrow_columns(texts):
    import pyarrow as pa

    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    seen = {}
    for i, j, data, offsets in textvec.runs(column):
        words = textvec.Words(data, offsets, True)
        for t in range(i, j):
            want = WORD.findall(texts[t] or "")
            at = slice(words.first[t - i], words.first[t - i + 1])
            assert [bytes(data[a:b]).decode() for a, b in zip(words.start[at], words.end[at])] == want
            for w, h in zip(want, words.hash[at].tolist()):
                key = "".join(c.lower() if c.isascii() else c for c in w)
                assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


# op2


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    marked = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n#é\x1c", max_size=60)))
def test_statistics_equal_brute_force(text):
    assert rules.text_statistics(text) == brute_statistics(text)


def test_rules_are_learned_and_hold_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = rules.train(docs, labels.where(F.xxhash64("doc_id") % 2 == 0))
    assert 1 <= len(learned.rules) <= 16 and "n_symbols" in learned.rules[0].sql()
    held = rules.quality_verdicts(docs, labels, learned).join(labels.where(F.xxhash64("doc_id") % 2 != 0), "doc_id").where("NOT base_failed").toPandas()
    assert (held["kept"] == (held["quality"] == 1)).mean() > 0.97 and held[held["quality"] == 1]["kept"].all()


def test_decision_list_covers_two_kinds_in_order():
    rng = np.random.default_rng(0)
    rows = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = (rows["a"] > 0.8) | ((rows["b"] < 0.2) & (rows["a"] < 0.5))
    learned = rules.learn(rows, bad, np.arange(2000) % 3)
    assert len(learned.rules) >= 2 and (learned.predict(rows) == ~bad).mean() > 0.98


def test_rules_on_odd_rows(spark, odd_documents, no_documents, labels):
    got = rules.quality_verdicts(odd_documents, labels).collect()
    assert len(got) == odd_documents.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 7, 8))
    assert rules.quality_verdicts(no_documents, labels).count() == 0 and rules.quality_verdicts(no_documents, labels.limit(0)).count() == 0
    kept = rules.quality_documents(odd_documents, labels.limit(0))
    assert kept.columns == odd_documents.columns and kept.where("n_words <> 'clash'").count() == 0


def test_verdicts_equal_the_list_by_hand(spark):
    """kept of the query: the base rules, then the first learned rule that holds, on statistics counted by brute force."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.train(docs, labels)
    got = {r["doc_id"]: r for r in rules.quality_verdicts(docs, labels).collect()}
    assert learned.rules
    for r in docs.collect():
        n, chars, symbols, lines, repeats = brute_statistics(r["text"])
        x = {"n_words": float(n), "word_length": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "dup_lines_per_word": lines / max(n, 1), "repeat_share": repeats / max(n, 1)}
        failed = n < 50 or 100 * repeats > 50 * n
        first = next((k for k in learned.rules if all(x[f] <= c if op == "<=" else x[f] > c for f, op, c in k.terms)), None)
        assert (got[r["doc_id"]]["base_failed"], got[r["doc_id"]]["kept"]) == (failed, not failed and (first is None or not first.reject))


# names of other columns


def test_no_column_clashes(spark, labels):
    """Columns that bear the names that operators use inside keep their values."""
    names = ["_k", "copies", "last_hash", "_tag", "_copies", "_last", "_turn", "_id", "_cuts", "_n_words", "N_WORDS", "kept", "c0", "component_id", "_copy", "hash", "_s"]
    text = " ".join(prose(1, 90))
    rows = [(i, (text if i % 3 == 0 else " ".join(prose(50 + i, 80))), "s" if i % 2 else None, 5, *[f"{n}-{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    outs = {"mix": mixing.mixed_documents(df), "cut": passages.without_repeats(df), "rules": rules.quality_documents(df, labels.limit(0)), "near": jaccard.without_near_copies(df)}
    for kind, out in outs.items():
        assert out.columns == df.columns, kind
        found = out.collect()
        assert found and all(tuple(r[4:]) == tuple(f"{n}-{r['doc_id']}" for n in names) for r in found), kind
    assert outs["near"].count() == 9 and {r["doc_id"] for r in outs["cut"].where("text = ''").collect()} == {3, 6, 9}


# op9


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed, base, copies, edits):
    """Copies of one text, each with its own few words changed."""
    r = random.Random(seed)
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        out.append(" ".join(w))
    return out


def test_jaccard_equals_brute_force(spark):
    base, other, hot = prose(1, 150), prose(2, 60), prose(3, 70)
    texts = family(5, base, 60, 5) + family(6, other, 40, 3) + [" ".join(prose(100 + i, 80) + hot) for i in range(60)] + [" ".join(prose(300 + i, random.Random(i).randint(0, 12))) for i in range(60)]
    texts += [t.upper() for t in texts[:10]] + ["a b c d", "a b  c\td", "A b c d", "a b c", None, "", " "]
    rows = list(enumerate(texts, 10))
    random.Random(9).shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_at_the_threshold(spark):
    # 100 * 8 >= 80 * 10 links; one shingle less does not
    w = prose(4, 13)
    rows = [(1, " ".join(w)), (2, " ".join(w[:-1])), (3, " ".join([*w[:11], "x"])), (4, " ".join(w[1:12]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_shown_tokens_bound_is_sound():
    """No linked pair shows fewer common prefix tokens than the bound asks for."""
    r = random.Random(0)
    for _ in range(300):
        n = r.randint(1, 60)
        a = set(r.sample(range(200), n))
        b = set(a)
        for _ in range(r.randint(0, max(1, n // 6))):
            b.discard(r.choice(sorted(b)) if len(b) > 1 else -1) if r.random() < 0.5 else b.add(r.randrange(200))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        p = {x: set(sorted(x_)[: int(jaccard.prefix_size(np.array([len(x_)]))[0])]) for x, x_ in (("a", a), ("b", b))}
        need = -(-80 * (len(a) + len(b)) // 180) - (-(-80 * max(len(a), len(b)) // 100) - 1)
        assert len(p["a"] & p["b"]) >= max(need, 1)


def test_least_shown_in_ranges(spark):
    """The range form is never above the minimum over the linkable sizes in both ranges."""
    r = random.Random(9)
    ranges = [(41, 41, 41, 50), (90, 90, 99, 100)]
    for _ in range(1500):
        lo, other = r.randrange(1, 150), r.randrange(1, 150)
        ranges.append((lo, lo + r.choice([0, 1, 5, 20]), other, other + r.choice([0, 1, 5, 20])))
    df = spark.createDataFrame(ranges, "a long, b long, c long, d long")
    got = df.select("*", jaccard.least_shown_in(*[F.col(x) for x in "abcd"]).alias("v")).collect()

    def shown(n, m):
        return -(-jaccard.SHARE * (n + m) // (jaccard.OVER + jaccard.SHARE)) + 1 - -(-jaccard.SHARE * max(n, m) // jaccard.OVER)

    for a, b, c, d, v in got:
        some = [shown(n, m) for n in range(a, b + 1) for m in range(c, d + 1) if jaccard.OVER * min(n, m) >= jaccard.SHARE * max(n, m)]
        if some:
            assert v <= min(some), (a, b, c, d)


def test_jaccard_on_odd_rows(spark, odd_documents, no_documents):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(odd_documents).collect()), key=str)
    assert len(got) == odd_documents.count()
    assert {g[2] for g in got if g[0] in (1, 6)} == {1} and {g[2] for g in got if g[0] in (4, 5)} == {4} and (None, 3, None) in got and (2, 0, 2) in got
    assert jaccard.similar(no_documents).count() == 0
    kept = jaccard.without_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "None", "7", "8"])


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("turned", [False, True])
def test_jaccard_of_rows_of_equal_id(spark, parts, turned):
    """Each text of an id has its own links, wherever its row lies."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (0, near(a)), (5, " ".join(c)), (5, None), (6, near(c)), (9, " ".join(prose(4, 80))), (None, " ".join(a))]
    rows = rows[::-1] if turned else rows
    docs = frame(spark, rows).repartition(parts) if parts > 1 else frame(spark, rows).coalesce(1)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs).collect()), key=str)
    assert got == sorted([(1, 76, 0), (1, 76, 0), (2, 76, 0), (0, 76, 0), (5, 76, 5), (5, 0, 5), (6, 76, 5), (9, 76, 9), (None, 76, None)], key=str)
    assert sorted(str(r["doc_id"]) for r in jaccard.without_near_copies(docs).collect()) == ["0", "5", "5", "9", "None"]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (500, 499)]
    got = {r["node"]: r["component"] for r in K.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 40)} == {1} and got[500] == 499
    assert K.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# op5


def test_passages_are_found_and_clean_texts_left(spark):
    passage, second = prose(1, 55), prose(2, 120)
    rows = [(i, " ".join(prose(100 + i, 300))) for i in range(40)]
    for i, at in ((3, 20), (9, 0), (17, 250), (30, 299)):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:at] + passage + w[at:]))
    edited = list(second)
    edited[40], edited[80] = "changed", "altered"
    rows[5], rows[25] = (5, " ".join(prose(7, 100) + second)), (25, " ".join(edited + prose(8, 100)))
    spans = {(r["doc_id"], r["start"], r["end"], r["ref_doc_id"]) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert spans == {(9, 0, 55, 3), (17, 250, 305, 3), (30, 299, 354, 3), (25, 0, 120, 5)}
    cut = {r["doc_id"]: r for r in passages.without_repeats(frame(spark, rows)).collect()}
    assert cut[9]["text"].split() == rows[9][1].split()[55:] and cut[9]["n_chars"] == len(cut[9]["text"]) and cut[3]["text"] == rows[3][1] and cut[0]["text"] == rows[0][1]
    assert cut[25]["text"].split() == prose(8, 100)


def test_edited_passages_of_holders_between_the_first_and_the_last(spark):
    whole = prose(11, 120)
    edited = list(whole)
    edited[45], edited[85] = "changed", "altered"  # no 50 words in a row are equal
    # the first and the last holder of all seeds have them in short pieces, in another order
    pieces = [whole[i : i + 30] for i in range(0, 105, 15)][::-1]
    scattered = lambda seed: sum((p + prose(seed + k, 40) for k, p in enumerate(pieces)), [])
    rows = [(1, " ".join(scattered(200))), (4, " ".join(prose(21, 80) + whole)), (6, " ".join(edited + prose(22, 80))), (9, " ".join(scattered(300)))]
    spans = [(r["doc_id"], r["start"], r["end"], r["ref_doc_id"], r["ref_start"], r["n_equal"]) for r in passages.repeated_passages(frame(spark, rows), every_holder=True).collect()]
    assert spans == [(6, 0, 120, 4, 80, 118)]
    assert {r["doc_id"]: r["text"].split() for r in passages.without_repeats(frame(spark, rows), every_holder=True).collect()}[6] == prose(22, 80)


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("turned", [False, True])
def test_passages_of_rows_of_equal_id(spark, parts, turned):
    """Each text of an id is cut at its own places, however short the others are."""
    passage, plain, short = prose(1, 60), prose(2, 300), prose(3, 30)
    rows = [(1, " ".join(prose(11, 100) + passage)), (2, " ".join(prose(12, 100) + passage)), (2, " ".join(plain)), (2, " ".join(short)), (2, None), (None, " ".join(passage))]
    rows = rows[::-1] if turned else rows
    docs = frame(spark, rows).repartition(parts) if parts > 1 else frame(spark, rows).coalesce(1)
    assert [tuple(r) for r in passages.repeated_passages(docs).collect()] == [(2, 100, 160, 1, 100, 160, 60)]
    left = sorted(((r["doc_id"], r["text"]) for r in passages.without_repeats(docs).collect()), key=str)
    want = [(i, " ".join(prose(12, 100)) if i == 2 and t and t.endswith(rows_end) else t) for i, t in rows for rows_end in [" ".join(passage)]]
    assert left == sorted(want, key=str)


def test_split_copies_are_joined_through_the_last_one(spark):
    passage = prose(1, 60)
    rows = [(1, " ".join(passage[:30] + prose(11, 100))), (2, " ".join(prose(12, 100) + passage[30:])), (3, " ".join(prose(13, 50) + passage + prose(14, 50))), (5, " ".join(prose(15, 80) + passage))]
    got = [(r["doc_id"], r["start"], r["end"], r["ref_doc_id"]) for r in passages.repeated_passages(frame(spark, rows)).collect()]
    assert got == [(5, 80, 140, 3)]


def test_parts_in_other_documents(spark):
    """A passage whose parts have other first and last holders is found between the two that hold all of it."""
    passage = prose(1, 60)
    parts = {1: passage[:35], 8: passage[:35], 2: passage[25:], 9: passage[25:], 3: passage, 5: passage}
    rows = [(i, " ".join(prose(20 + i, 70) + p + prose(40 + i, 70))) for i, p in parts.items()]
    got = [(r["doc_id"], r["start"], r["end"], r["ref_doc_id"], r["ref_start"], r["ref_end"]) for r in passages.repeated_passages(frame(spark, rows)).collect()]
    assert got == [(5, 70, 130, 3, 70, 130)]


def test_periodic_passages(spark):
    phrase = prose(1, 7) * 20
    rows = [(1, " ".join(prose(21, 60) + phrase)), (2, " ".join(phrase + prose(22, 60)))]
    got = [(r["doc_id"], r["start"], r["end"]) for r in passages.repeated_passages(frame(spark, rows)).collect()]
    assert [(2, 0, 140)] == got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40, unique=True))
def test_chains_equal_quadratic_search(pairs):
    o, h = (np.array(x) for x in zip(*sorted(pairs)))
    score = []
    for i in range(len(o)):
        before = [score[j] - passages.GAP_COST * (o[i] - o[j] + h[i] - h[j]) for j in range(i) if o[j] < o[i] and h[j] < h[i]]
        score.append(passages.GAIN + max(0.0, *before) if before else passages.GAIN)
    best = max(score)
    found = passages.chains(o, h)
    worth = [len(c) * passages.GAIN - passages.GAP_COST * sum(o[b] - o[a] + h[b] - h[a] for a, b in zip(c, c[1:])) for c in found]
    assert all((np.diff(o[c]) > 0).all() and (np.diff(h[c]) > 0).all() for c in found)
    assert (max(worth) if worth else passages.GAIN) == pytest.approx(best) if best > passages.GAIN else not worth
    used = [i for c in found for i in c]
    assert len(used) == len(set(used))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 60)), min_size=1, max_size=30), min_size=1, max_size=4))
def test_rising_chains_equal_the_dynamic_program(pairs):
    places = [np.cumsum(np.array(p), axis=0).T for p in pairs]
    o, h = (np.concatenate([p[k] for p in places]) for k in (0, 1))
    sizes = [len(p) for p in pairs]
    new = np.isin(np.arange(len(o)), np.cumsum([0, *sizes[:-1]]))
    got = {(a, b) for a, b in zip(*(x.tolist() for x in passages.rising_chains(o, h, new))) if b - a > 1}
    want, at = set(), 0
    for x, y in places:
        found = passages.chains(x, y)
        assert all((np.diff(c) == 1).all() for c in found)
        want |= {(at + int(c[0]), at + int(c[-1]) + 1) for c in found}
        at += len(x)
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60))
def test_dense_stretches(equal):
    e = np.array(equal)
    found = passages.dense(e)
    for a, b in found:
        assert e[a:b].sum() > passages.IDENTITY * (b - a) and e[a] and e[b - 1]
    assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
    worth = lambda a, b: e[a:b].sum() - 4 * (~e[a:b]).sum()
    best = max(worth(a, b) for a in range(len(e)) for b in range(a + 1, len(e) + 1))
    assert best <= 0 or max(worth(a, b) for a, b in found) == best


def brute_exact(rows, n=50):
    """By document, the words inside runs of n words that an earlier document holds."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = (t or "").split(" ")
        grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
        held = {k for i, g in enumerate(grams) if g in seen for k in range(i, i + n)}
        if held:
            out[d] = held
        for g in grams:
            seen.setdefault(g, d)
    return out


def test_every_exact_repeat_is_covered(spark):
    """Repeats that overlap, split and come from several documents; and texts of their own stay whole."""
    r = random.Random(11)
    pool = [prose(500 + i, 160) for i in range(6)]
    rows = []
    for d in range(70):
        parts = [prose(1000 + d, r.randint(5, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, 100)
            parts += [p[a : a + r.randint(30, 120)], prose(r.randrange(10**6), r.randint(0, 40))]
        rows.append((d, " ".join(w for p in parts for w in p)))
    rows += [(100 + i, " ".join(prose(9000 + i, 200))) for i in range(5)]
    want = brute_exact(rows)
    got = {}
    for x in passages.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(x["doc_id"], set()).update(range(x["start"], x["end"]))
    assert len(want) > 20 and all(want[d] <= got.get(d, set()) for d in want)
    assert not any(d >= 100 for d in got)


def test_edited_passages(spark):
    """A passage with a stretch replaced is found on both sides of it; one word in eight replaced is found, too."""
    base, r = prose(1, 164), random.Random(4)
    cut = [*base[:100], *prose(2, 24), *base[124:]]
    many = [w if r.random() > 0.125 else "changed" for w in prose(3, 80)]
    rows = [(1, " ".join(prose(5, 50) + base)), (2, " ".join(cut + prose(6, 50))), (3, " ".join(prose(3, 80) + prose(7, 60))), (4, " ".join(prose(8, 60) + many))]
    got = {}
    for x in passages.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(x["doc_id"], set()).update(range(x["start"], x["end"]))
    assert {*range(100), *range(124, 164)} <= got[2] and max(got[2]) < 166
    assert len(got[4] & set(range(60, 140))) >= 70


def test_passages_on_odd_rows(spark, odd_documents, no_documents):
    got = passages.repeated_passages(odd_documents).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == {(5, 0, 60_000)}
    cut = passages.without_repeats(odd_documents)
    assert cut.columns == odd_documents.columns and cut.count() == odd_documents.count()
    assert {r["text"] for r in cut.where("doc_id = 5").collect()} == {" tail"}
    assert passages.repeated_passages(no_documents).count() == 0 and passages.without_repeats(no_documents).count() == 0


# op6


def test_cross_entropy_difference(spark, odd_documents, no_documents, labels):
    docs, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = lm.cross_entropy_difference(docs, marks).join(marks, "doc_id").where("n_tokens > 20").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"].to_numpy(), rows[rows["quality"] == 0]["score"].to_numpy()
    assert np.mean(bad[:, None] > good[None]) > 0.9  # held out: no document is scored by its own counts
    got = lm.cross_entropy_difference(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm.cross_entropy_difference(no_documents, labels).count() == 0
    assert lm.cross_entropy_difference(odd_documents, labels.limit(0)).count() == len(got)


def brute_losses(texts, target, fold, mu):
    """Per text, bits a token in the target of the other folds and in the background, from plain counts."""
    def model(some):
        one, two = collections.Counter(), collections.Counter()
        for t in some:
            w = ["", *t, ""]
            one.update(w[1:])
            two.update(zip(w, w[1:]))
        return one, two, sum(one.values())

    size = len({w for t in texts for w in t} | {""})
    back = model([t for t in texts if t])
    near = [model([t for i, t in enumerate(texts) if t and i in target and fold[i] != k]) for k in range(lm.FOLDS)]

    def loss(t, one, two, total):
        w = ["", *t, ""]
        p = [(two[a, b] + mu * (one[b] + 1) / (total + size)) / (one[a] + mu) for a, b in zip(w, w[1:])]
        return -np.mean(np.log2(p))

    return [(loss(t, *near[fold[i]]), loss(t, *back)) if t else None for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_losses_equal_brute_force(spark, monkeypatch, small):
    """Every word and bigram has counts of its own; with small blocks, groups and lists too."""
    if small:
        for name, value in (("BLOCK_WORDS", 700), ("GROUP_WORDS", 600), ("LISTED", 5)):
            monkeypatch.setattr(lm, name, value)
    r = random.Random(5)
    texts = [[f"w{r.choice([r.randrange(9), r.randrange(3000)])}" for _ in range(r.choice([1, 2, 30]))] for _ in range(200)] + [["hot", "pair"]] * 80 + [[]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = docs.where("doc_id < 20 OR doc_id = 230").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    fold = {x["doc_id"]: x["f"] for x in docs.select("doc_id", F.expr(f"pmod(xxhash64(doc_id), {lm.FOLDS})").alias("f")).collect()}
    want = brute_losses(texts, {*range(20), 230}, fold, lm.MU)
    got = lm.cross_entropy_difference(docs, marks).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(len(texts)))
    for x in got:
        i = x["doc_id"]
        assert x["n_tokens"] == len(texts[i])
        if texts[i]:
            assert (x["ce_target"], x["ce_background"]) == (pytest.approx(want[i][0], abs=1e-4), pytest.approx(want[i][1], abs=1e-4))


# op8


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, dict(sizes), share * sum(sizes.values())
    while rest:
        level = left / sum(w[s] for s in rest)
        full = [s for s in rest if level * w[s] > 2 * sizes[s]]
        if not full:
            return target | {s: level * w[s] for s in rest}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del rest[s]
    return target


def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([1, 5, 20, 60])), r.choice(["a", "a", "a", "b", "Z", "é", None]), 0) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(df).toPandas()
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    for s, part in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert part["target"].iloc[0] == pytest.approx(want[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs(part["taken"].sum() - want[s]) <= 60
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"] == 0).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert dict(zip(again["doc_id"], again["taken"])) == dict(zip(got["doc_id"], got["taken"]))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == int((got["taken"] // got["size"]).sum())


def test_mix_on_odd_rows(spark, odd_documents, no_documents):
    got = mixing.mix(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 7))
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    empty = mixing.mix(odd_documents.where("doc_id IN (2, 3)")).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


# op10


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "a  b\n\n", " x <|endoftext|> y", "Ünï it's we'll 123²½ ", "\n \n", "👍🏽 ok\r\n\tq", "a" * 5000, "漢字" * 500]
    for t in texts:
        assert encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 100))
def test_only_the_first_piece_is_shorter(length):
    parts = packing.cut(length, 16)
    assert parts[0][0] == 0 and sum(n for _, n in parts) == length and all(n == 16 for _, n in parts[1:]) and 1 <= parts[0][1] <= 16
    assert all(s == sum(n for _, n in parts[:k]) for k, (s, _) in enumerate(parts))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=32, max_size=32))
def test_plans_use_every_length_as_often_as_counted(counts):
    counts = np.array(counts)
    plan = packing.pack_plan(counts, 32, 40)
    used = collections.Counter()
    for config, times in plan:
        assert sum(n * k for n, k in config) <= 32
        for n, k in config:
            used[n] += k * times
    assert used == {n + 1: c for n, c in enumerate(counts) if c}
    bound = -(-int((counts * np.arange(1, 33)).sum()) // 32)
    assert sum(t for _, t in plan) <= 1.25 * bound + 2


def test_knapsack_prices_are_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        prices = np.where(rng.random(20) < 0.6, rng.random(20), 0)
        best = np.zeros(21)
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - n] + prices[n - 1] for n in range(1, c + 1))])
        got = packing.best_configuration(prices, 20)
        assert sum(prices[n - 1] * k for n, k in got.items()) == pytest.approx(best[20])


def test_long_white_space_is_encoded():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.Encoder(packing.tokenizer_path())
    for text in (" " * 2_000_000, "a" + "\n" * 1_000_000 + "b"):
        assert encode(text) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_places_every_token(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(odd_documents).toPandas()
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in odd_documents.collect())
    want = collections.Counter()
    for (doc, text), times in texts.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += times
    have = collections.Counter((None if d != d else int(d), *map(int, r)) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == list(np.cumsum([0, *part["length"][:-1]])) and part["length"].sum() <= 2048
    assert packing.pack(no_documents).count() == 0


def test_packing_is_near_the_bound(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
