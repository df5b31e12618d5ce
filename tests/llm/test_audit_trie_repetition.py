"""Repetition, the trie of conversations, the divergence audit and the hashes of words, against brute force on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import divergence, extraction, hashing, near_dedup, prefix_trie, repetition, suffix_tree
from tests.parity import plain

CLASHING = ("row", "n", "c", "d", "o", "w", "value", "rank", "term", "count", "p", "q", "at", "pos", "n_words", "kept", "first", "length", "low", "high", "digest", "size", "need")


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns}).repartition(3)


# repetition


def brute_repetition(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>")}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len(re.sub(r"[\x20\x09-\x0D]+", "", x)) for x in again)}
    for n in range(2, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts = Counter(grams)
        inside = lambda wanted: {i + j for i, g in enumerate(grams) if wanted(g) for j in range(n)}  # noqa: B023,E731
        if n in repetition.MOST_TOP:
            twice = [g for g in counts if counts[g] > 1]
            best = min(twice, key=lambda g: (-counts[g], -len("".join(g)), grams.index(g)), default=None)
            out[f"top_{n}_chars"] = sum(len(words[i]) for i in inside(lambda g: g == best))  # noqa: B023
        else:
            found = inside(lambda g: counts[g] > 1)  # noqa: B023
            out[f"dup_{n}_chars"] = sum(len(words[i]) for i in found)
            if n == 5:
                out["n_repeat_words"] = len(found)
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    rules = [("line_chars", out["dup_line_chars"], 20)] + [(f"top_{n}", out[f"top_{n}_chars"], m) for n, m in repetition.MOST_TOP.items()] + [(f"dup_{n}", out[f"dup_{n}_chars"], m) for n, m in repetition.MOST_DUPLICATED.items()]
    out["broken"] = "base" if out["base_failed"] else next((name for name, part, most in rules if 100 * part > chars * most), None)
    return out | {"kept": out["broken"] is None}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = ["".join(r.choices("aAbBcé#$ ", k=r.randrange(1, 5))) for _ in range(40)]
    text = lambda n: "".join(w + r.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for w in r.choices(words, k=n))
    out = [None, "", " \n\t", "one", "a a a a a a a a a a a a", "a b " * 30, "x y z w v u t s r q " * 3, "line one\nline one\nother line\nline one \n", text(3000), "é" * 5000]
    part = text(40)
    return out + [text(r.randrange(5, 200)) for _ in range(40)] + [text(100) + part + text(60) + part, part + "\n" + part]


def test_repetition(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (3, texts[3])]
    got = repetition.judged(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")))
    names = ["doc_id", *repetition.NAMES, "base_failed", "broken", "kept"]
    assert got.columns == names
    want = [(i, *[brute_repetition(t)[c] for c in names[1:]]) for i, t in rows]
    assert plain(got.collect()) == plain(want)
    assert repetition.judged(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repetition_when_hashes_meet(texts, monkeypatch):
    """N-grams are told apart exactly if all their hashes are the same."""
    want = [repetition.measure((t or "").encode()) for t in texts]
    monkeypatch.setattr(repetition, "mix", lambda h: h % np.uint64(2))
    assert [repetition.measure((t or "").encode()) for t in texts] == want


def test_words_over_slices(monkeypatch):
    data = " ".join(f"wörd{i % 77}" for i in range(2000)).encode()
    whole = repetition.measure(data)
    monkeypatch.setattr(repetition, "white_slices", lambda data: __import__("rasterloom.llm.common", fromlist=["x"]).white_slices(data, 50))
    assert repetition.measure(data) == whole


# trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(role, text) for _, _, role, text in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    nodes = sorted(members, key=len, reverse=True)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for key in nodes:
        saved[key] += (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        leaves[key] += kids[key] == 0
        if key:
            kids[key[:-1]] += 1
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    out = []
    for key in nodes:
        ended = ",".join(map(str, sorted(c for c in members[key] if built[c] == key)))
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), kids[key], leaves[key], saved[key], hashlib.sha256(ended.encode()).hexdigest()))
    return out


TRIE = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    r = random.Random(12)
    rows = []
    for c in [*range(0, 60), *range(97, 140), 200, 201, 305, -1, -100, -101, -199, 10**12, 10**12 + 7]:
        for t in range(r.randrange(0, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, "a longer text"])))
    rows += [(70, t, "user", f"long {t % 3}") for t in range(700)] + [(71, t, "user", f"long {t % 3}") for t in range(650)]
    rows += [(72 + i, t, "user", "same") for i in range(8) for t in range(6)]  # equal conversations, but for what they take
    rows += [(5, None, "user", "without a turn"), (5, None, None, None), (6, 1, "user", "tie"), (6, 1, "user", "tie"), (6, 1, "system", "tie"), (None, 0, "user", "of no conversation")]
    return rows


@pytest.mark.parametrize("block", [(256, 4096), (4, 8)])
def test_trie(spark, turns, block):
    got = prefix_trie.prefix_trie(with_clashes(spark.createDataFrame(turns, TRIE)), *block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert plain(got.collect()) == plain(brute_trie(turns))


def test_trie_of_a_staircase(spark):
    """Each conversation goes one turn along with the one before: as many chains below each other as conversations."""
    rows = [(c, t, "user", f"{t}" if t < c - 1000 else f"{t} of {c}") for c in range(1000, 1040) for t in range(c - 1000 + 7)]
    assert plain(prefix_trie.prefix_trie(spark.createDataFrame(rows, TRIE)).collect()) == plain(brute_trie(rows))


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_trie_of_nothing(spark, rows):
    assert prefix_trie.prefix_trie(spark.createDataFrame(rows, TRIE)).collect() == []


def test_trie_of_conversations_without_turns(spark):
    """Conversations whose own turns all go, and whose family's first isn't there."""
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2]
    rows = [(c, 0, "user", "gone") for c in ids]
    assert plain(prefix_trie.prefix_trie(spark.createDataFrame(rows, TRIE)).collect()) == plain(brute_trie(rows))


# divergence


def brute_audit(rows, top, least):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [(s, w) for x, s, w in docs if x == lang]
        in_docs = Counter(t for _, w in mine for t in set(w))
        terms = [t for t in in_docs if in_docs[t] >= least]
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(t for t in w if in_docs[t] >= least)
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(terms)) for t in terms}  # noqa: B023,E731
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            found = sorted((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(found, 1)]
            found = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in terms if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(found, 1)]
    return out


AUDIT = "lang string, source string, text string"


@pytest.fixture(scope="module")
def audited():
    r = random.Random(13)
    words = ["".join(r.choices("abXé漢", k=r.randrange(1, 4))) for _ in range(150)]
    rows = [(r.choice(["de", "en", None, ""]), r.choice(["s0", "s0", "s1", "s2", "é", None]), " ".join(r.choices(words, k=r.randrange(0, 30)))) for _ in range(150)]
    # ties: terms that each occur once in three documents of one source, with long common beginnings
    ties = [f"{'same' * 20}{a}{b}{'z' * (i % 3)}" for i, (a, b) in enumerate((a, b) for a in "abcé" for b in "xyz")] + ["same" * 20]
    rows += [("fr", "tied", " ".join(r.sample(ties, len(ties)))) for _ in range(3)] + [("fr", "other", "un mot")] * 3
    return rows + [("one", "alone", "a b c")] * 4 + [("none", "x", "12 34"), ("none", "y", None), ("rare", "x", "hapax"), ("rare", "y", "legomenon")]


@pytest.mark.parametrize(("top", "bits"), [(200, 12), (5, 12), (5, 3), (1, 1)])
def test_audit(spark, audited, top, bits):
    got = divergence.audit(with_clashes(spark.createDataFrame(audited, AUDIT)), top=top, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert plain(got.collect()) == plain(brute_audit(audited, top, 3))


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], AUDIT)).collect() == []


def test_audit_counts_in_parts(spark, audited, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_COUNTED", 7)
    rows = divergence.counted(spark.createDataFrame(audited, AUDIT)).groupBy("lang", "source", "term").agg(F.sum("count").alias("n"), F.sum("docs").alias("docs"))
    want = Counter()
    for lang, source, text in audited:
        for t, n in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))).items():
            want[lang or "", source or "", t, "n"] += n
            want[lang or "", source or "", t, "docs"] += 1
    assert {(r.lang, r.source, r.term, k): r[k] for r in rows.collect() for k in ("n", "docs")} == dict(want)


@pytest.mark.parametrize("most", [1, 10, 1000])
def test_pairs_of_sources_in_parts(most, monkeypatch):
    import pyarrow as pa

    r = random.Random(5)
    rows = [("l", t, f"s{s}", r.randrange(1, 10**9), 3 + s) for t in ("a", "b", "c") for s in range(12) if r.random() < 0.8]
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for _, t, s, p, p0 in rows:
        for _, t2, s2, q, q0 in rows:
            if t == t2 and s != s2:
                want["l", s, s2] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    monkeypatch.setattr(divergence, "MOST_PAIRS", most)
    batches = [pa.RecordBatch.from_pylist([dict(zip(["lang", "term", "source", "p", "p0"], x)) for x in rows[i : i + 5]]) for i in range(0, len(rows), 5)]
    got = Counter()
    for b in divergence.both_terms(iter(batches)):
        for x in b.to_pylist():
            got[x["lang"], x["source"], x["item"]] += x["value"]
    assert got == want


# hashes


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_words_that_polynomials_confuse(n):
    one = thue_morse(n)
    other = one.translate({97: 98, 98: 97})
    a, b = hashing.word_hashes([one.encode(), other.encode()])
    assert a != b
    assert len(np.intersect1d(hashing.shingles([one.encode()] * 7, 5), hashing.shingles([other.encode()] * 7, 5))) == 0


def test_texts_of_such_words_are_apart(spark):
    one = thue_morse(1024)
    other = one.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 1, True), (2, 2, True), (3, 1, False)}
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    out = next(i for i in range(40) if i not in train)
    docs = spark.createDataFrame([*[(i, one) for i in train[:5]], (out, f"{one} {other}")], "doc_id long, text string")
    held = [r for r in suffix_tree.score_documents(docs).collect() if r.held_out]
    assert [(r.n_tokens, r.n_known) for r in held] == [(3, 2)]  # one of the words, and the end


def test_runs_of_words_depend_on_order_and_place():
    words = [b"a", b"b", b"a", b"b", b"b", b"a", b"a"]
    for width in (1, 2, 3):
        hashes = hashing.word_hashes(words, width).tolist()
        runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        assert len(set(zip(runs, hashes))) == len(set(runs)) == len(set(hashes))
    assert len(hashing.word_hashes(words, 9)) == 0


# long pages


@pytest.mark.parametrize("page", ["<p><td>" + "<x>" * 140_000 + "</p>" * 140_000, "<li><ul>" + "<x>" * 120_000 + "<li>" * 120_000, "<p>" + "<div><p></div>" * 70_000], ids=["unclosed", "items", "blocks"])
def test_deep_pages_take_linear_time(page):
    start = time.time()
    assert len(extraction.parse(page)) > 100_000 and time.time() - start < 20


def test_features_of_a_long_page_are_not_held_at_once():
    nodes = extraction.parse("<p class=ad>x" * 60_000)
    whole = extraction.describe(nodes)
    tracemalloc.start()
    for at, part in enumerate(extraction.described(nodes, 1000)):
        assert np.array_equal(part, whole[at * 1000 : at * 1000 + 1000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < whole.nbytes / 5


def test_pages_long_and_short_keep_their_order(monkeypatch):
    model = extraction.trained(60)
    pages = [f"<article><p>{'Some words of an article, as it were. ' * (1 + k % 7)}{k}</p></article>" * (1 + 9 * (k % 4 == 0)) for k in range(12)]
    want = [extraction.extract([p], model)[0] for p in pages]
    monkeypatch.setattr(extraction, "SLICE_NODES", 8)
    assert extraction.extract(pages, model) == want
