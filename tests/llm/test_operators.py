"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against
brute force."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, exact_dedup, extraction, hashing, near_dedup, packing, pieces, quality, queries, suffix_tree, syncmers, urls, warc
from rasterloom.llm.common import words_bytes
from tests.parity import assert_same, connect

SF = "/root/testdata/sf0.001"
WHITE = r"[\x20\x09-\x0D]"


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text) with every odd case."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdeé", k=r.randrange(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(r.choices(words, k=n))
    long = text(30_000)
    base = text(60)
    out = [(0, base), (1, base.replace(" ", "\n")), (2, base.upper()), (3, base + " more words at the end"), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "two one"), (9, "one  two"), (10, long), (11, long + " x"), (12, long), (None, "no id"), (14, "▁ x  ▁▁y\x00"), (15, base), (15, base), (16, "日本語のテキスト " * 40)]
    out += [(20 + i, text(r.randrange(0, 120))) for i in range(60)]
    for i in range(20):
        w = out[20 + 2 * i][1].split(" ") if out[20 + 2 * i][1] else [""]
        w[r.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("row", "words", "name", "rank", "component", "kept", "score", "lang", "n_chars", "range", "dealt", "label")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("1 = 0")


def held_out(doc_id, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == k


def test_packing(docs, rows, nothing):
    got = packing.pack_documents(docs, (16, 64, 256)).collect()
    pieces_, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces_[r.doc_id].append((r.start, r.n_tokens))
        bins[r.bin_id].append(r)
    want = Counter()
    for i, t in rows:
        want[i] += len(words_bytes(t or "")) + 1
    assert {i: sum(n for _, n in p) for i, p in pieces_.items()} == dict(want)
    for b in bins.values():
        spans = sorted((r.bin_offset, r.n_tokens) for r in b)
        assert spans[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:]))
        held = sum(n for _, n in spans)
        assert {r.bin_tokens for r in b} == {held} and {r.bin_length for r in b} == {min(x for x in (16, 64, 256) if x >= held)}
    assert packing.pack_documents(nothing).count() == 0


def test_pack_is_best_fit():
    """Against a search through all open bins."""
    r = random.Random(1)
    for _ in range(50):
        lengths = sorted(r.sample([8, 16, 32, 64, 100], 3))
        sizes = [r.randrange(1, lengths[-1] + 1) for _ in range(r.randrange(0, 60))]
        bins, offsets, final = packing.pack(sizes, lengths, 3, 300)
        open_, left = [], list(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            left.remove(sizes[i])
            free = [b[1] - b[0] for b in open_ if b[1] - b[0] >= sizes[i]]
            if free:
                assert open_[bins[i]][1] - open_[bins[i]][0] == min(free)
            else:
                assert bins[i] == len(open_)
                cost = {}
                for n in lengths:
                    if n >= sizes[i]:
                        held = sizes[i]
                        for other in sorted(left, reverse=True):
                            held += other if held + other <= n else 0
                        cost[n] = (n + n * n / 300 + 3) / held
                open_.append([0, min(cost, key=lambda n: (cost[n], n))])
            assert offsets[i] == open_[bins[i]][0]
            open_[bins[i]][0] += sizes[i]
            assert open_[bins[i]][0] <= open_[bins[i]][1]
        assert final == [min(n for n in lengths if n >= b[0]) for b in open_]


def test_several_lengths_are_chosen():
    """Bins of several lengths, whose padding is less than with any single length."""
    r = random.Random(3)
    sizes = [min(8192, max(1, int(r.lognormvariate(6, 1.2)))) for _ in range(5000)]
    padding = lambda lengths: sum(packing.pack(sizes, lengths)[2]) - sum(sizes)
    final = Counter(packing.pack(sizes)[2])
    assert len(final) >= 4 and max(final.values()) < 0.9 * sum(final.values())
    assert padding(packing.LENGTHS) < padding((8192,))


def test_url_rules_of_the_query(spark, tmp_path):
    """The five rules: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    cases = [
        ("https://a.com/en/1", "com/en/", "block"), ("https://example.com/en/8", "com/en/", "block"), ("https://www.example.com/en/7x", "example.com/en/7", "allow"), ("https://a.net/de/8", "net/de/", "allow"),
        ("https://example.net/de/7", "net/de/", "allow"), ("https://m.example.net/de/81?q", "example.net/de/8", "block"), ("https://b.org/es/x", "org/es/", "block"), ("https://b.org/en/x", None, "allow"), ("https://xcom/en/", None, "allow"), (None, None, "allow"),
    ]
    spark.createDataFrame([(i, u, "") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(cases)}


def test_urls(spark):
    listed = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("a.net", "/x", "allow")]
    given = [(1, "http://A.Example.com/en/71?x#y"), (2, "https://b.com/en/7"), (3, None), (4, "no scheme"), (5, "x://net"), (6, "ftp://q.a.NET/xy?://"), (7, "http://notcom/en/"), (7, "http://notcom/en/"), (8, "://com/en/"), (None, "http://.com/en/"), (9, "http://com?/en/")]
    pages = spark.createDataFrame(given, "page_id long, url string").withColumn("rule", F.lit("clash"))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
        fits = [(len(h + p), h + p, a) for h, p, a in listed if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for most in (10, 0):
        got = urls.filter_urls(pages, spark.createDataFrame(listed, "host string, path string, action string"), most_broadcast=most)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *judge(u))) for i, u in given)
    assert urls.filter_urls(pages, spark.createDataFrame([], "host string, path string, action string")).where("verdict <> 'allow'").isEmpty()


def test_urls_of_very_long_hosts(spark):
    """A host of 100,000 labels has as many keys as the list has label counts."""
    host = "a." * 100_000
    listed = spark.createDataFrame([("com", "/x", "block"), ("b.c.com", "/", "allow")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, f"http://{host}com/xy"), (2, f"http://{host}b.c.com/xy"), (3, f"http://{host}"), (4, "http://com/x")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, listed).collect()} == {1: ("com/x", "block"), 2: ("b.c.com/", "allow"), 3: (None, "allow"), 4: ("com/x", "block")}


def test_bloom_filter_lets_few_through(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("action"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), F.col("id").cast("string"), F.lit(".com/a")).alias("url"))
    assert urls.filter_urls(pages, listed).where("verdict = 'block'").count() == 3000


def test_suffix_tree(docs, rows, nothing):
    options = suffix_tree.Options(divergence=-1.0, group_tokens=9000)
    got = sorted(map(tuple, suffix_tree.score_documents(docs, options).collect()), key=str)
    train, tokens = Counter(), []
    for i, t in rows:
        w = [*words_bytes(t or ""), None]
        tokens.append((i, w))
        if not held_out(i, 1):
            train.update(w)
    n, v = sum(train.values()), len(train)
    want = sorted(((i, held_out(i, 1), len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens), key=str)
    by = lambda r: (str(r[0]), r[2], r[3])
    for g, w in zip(sorted(got, key=by), sorted(want, key=by)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
    assert any(r[7] for r in got)
    assert suffix_tree.score_documents(nothing).count() == 0


def brute_suffix_tree(rows, options):
    """score and n_context of each (doc_id, text), and how many contexts of each length, from counts of the words themselves."""
    counts, split = Counter(), {i: [*words_bytes(t), None] for i, t in rows}
    for i, w in split.items():
        if not held_out(i, 1):
            counts.update(tuple(w[k : k + n]) for n in range(1, options.longest + 2) for k in range(len(w) - n + 1))
    tokens, distinct = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    least = max(options.least, options.root * tokens**0.5)
    kept = set()
    for context, own in counts.items():
        if len(context) > options.longest or own < least or context[-1] is None:
            continue
        after = {g: c for g, c in counts.items() if g[:-1] == context and counts[g[-1],] >= least}
        if not after:
            continue
        total = tokens if len(context) == 1 else counts[context[1:]]
        p, q = [c / own for c in after.values()], [counts[g[1:]] / total for g in after]
        rest_p, rest_q = max(1 - sum(p), 1e-9), max(1 - sum(q), 1e-9)
        if sum(x * math.log(x / y) for x, y in zip(p, q)) + rest_p * math.log(rest_p / rest_q) - len(p) / (2 * own) >= options.divergence:
            kept |= {context[k:] for k in range(len(context))}
    out = {}
    for i, w in split.items():
        score = inside = 0
        for k in range(len(w)):
            p, deep = (counts[w[k],] + 0.5) / (tokens + 0.5 * (distinct + 1)), 0
            for n in range(1, options.longest + 1):
                if k >= n and (context := tuple(w[k - n : k])) in kept:
                    worth, deep = options.prior[n - 1] * math.sqrt(counts[context]), 1
                    p = (counts[*context, w[k]] + worth * p) / (counts[context] + worth)
            score, inside = score + math.log10(p), inside + deep
        out[i] = (score, inside)
    return out, Counter(map(len, kept))


@pytest.mark.parametrize("partitions", [1, 60])
def test_suffix_tree_scores_do_not_depend_on_the_layout(spark, partitions):
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(240):
        w = [r.choice(words)]
        for _ in range(30):
            k = words.index(w[-1])
            w.append(words[(k * 7 + r.randrange(4)) % 40] if r.random() < 0.5 + k / 100 else r.choice(words))
        rows.append((i, " ".join(w)))
    options = suffix_tree.Options(root=0.05, divergence=0.3, group_tokens=2000)
    want, lengths = brute_suffix_tree(rows, options)
    assert 0 < sum(x[1] for x in want.values()) and all(lengths[n] for n in (1, 2, 3))
    got = {x.doc_id: (x.score, x.n_context) for x in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions), options).collect()}
    assert got == {i: (pytest.approx(s), n) for i, (s, n) in want.items()}


@pytest.mark.parametrize("placed", [1, 7, 40, 10_000])
def test_grams_by_ranges_of_documents(monkeypatch, placed):
    monkeypatch.setattr(suffix_tree, "PLACED", placed)
    rng = np.random.default_rng(placed)
    words = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    counts = rng.integers(1, 20, 30)
    one = rng.choice(words, counts.sum())
    grams = suffix_tree.Grams(one, counts)
    parts = list(grams.parts())
    assert np.array_equal(np.concatenate([part.one for _, part in parts]), one)
    assert [n for documents, _ in parts for n in counts[documents]] == counts.tolist()
    assert all(len(part.one) <= placed or len(part.counts) == 1 for _, part in parts)

    level = suffix_tree.Contexts(np.sort(words[:5]), np.ones(5, np.int64), np.zeros(5, np.int64))
    training = rng.random(30) < 0.5
    keys, n = grams.tallied(suffix_tree.TreeShape(len(one), 12, [level]), training)
    want = {}
    for start, size, trains in zip(grams.starts, counts, training):
        for i in range(start, start + size):
            found = [one[i]] + ([suffix_tree.join(one[i - 1 : i], one[i : i + 1])[0]] if i > start and one[i - 1] in level.hashes else [])
            for key in found:
                want[int(key)] = want.get(int(key), 0) + bool(trains)
    assert list(zip(keys.tolist(), n.tolist())) == sorted(want.items())


def test_tokens_are_the_words_of_each_text():
    r = random.Random(6)
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # Thue and Morse's, of 1,024 letters
    words = [a, b, *("x" * n for n in range(1, 80)), *("x" + "\0" * n for n in range(1, 40)), *("é" * n for n in range(1, 20)), "日本語", "\u2028", "\xa0", "\x1c", "A", "Z", "@", "[", "ÀÉ", "😀"]
    texts = [None, "", " \t\n\x0b\x0c\r", "ends", "starts", " white ", "", None]
    texts += ["".join(x for w in r.choices(words, k=r.randrange(40)) for x in (w.upper() if r.random() < 0.3 and w.isascii() else w, r.choice([" ", "\n", "\t \r", "\x0b", "\x0c"]))) for _ in range(200)]
    texts += [t.strip(" ") for t in texts if t]
    seen, column = {}, pa.array(["before", *texts])[1:]
    for kind in (pa.string(), pa.large_string()):
        hashes, counts = suffix_tree.tokens_of(column.cast(kind))
        want = [[*words_bytes(t or ""), None] for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        tokens = [x for w in want for x in w]
        assert all(seen.setdefault(w, h) == h for w, h in zip(tokens, hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) > 100
    for none in ([None], [""], ["", None]):
        assert suffix_tree.tokens_of(pa.array(none, pa.string()))[0].tolist() == [int(suffix_tree.END)] * len(none)


def test_hashes_of_words_of_different_lengths_made_to_agree():
    """Were a word's first bytes and its length, times the step, only added up, these pairs would have one hash."""
    for short in range(1, 8):
        word = b"abcdefg"[:short]
        other = ((int.from_bytes(word, "little") - (8 - short) * int(hashing._STEP)) % (1 << 64)).to_bytes(8, "little")
        found = hashing.hashes_at(np.frombuffer(word + other + bytes(8), np.uint8), np.array([0, short]), np.array([short, 8]))
        assert found[0] != found[1]


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_pieces_are_all_rows_in_order(monkeypatch, most):
    monkeypatch.setattr(suffix_tree, "BYTES", most)
    texts = ["é" * n if n % 3 else None for n in range(40)]
    slices = [p.column("text") for p in suffix_tree.pieces_of(pa.record_batch({"text": pa.array(["before", *texts])})[1:])]
    assert [t for p in slices for t in p.to_pylist()] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= most for p in slices)


def test_tokens_take_less_time_than_words_apart():
    """Six passes over the texts make tokens; by a Python object and a call for each word, these took a third of op3's CPU seconds."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(1, 12))) for _ in range(50_000)]
    batch = pa.record_batch({"text": pa.array([" ".join(r.choices(words, k=500)) for _ in range(800)])})

    def least(f):
        took = []
        for _ in range(5):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    apart = least(lambda: [words_bytes(t) for t in batch.column("text").to_pylist()])
    assert least(lambda: [suffix_tree.tokens_of(p.column("text")) for p in suffix_tree.pieces_of(batch)]) < 1.5 * apart


def test_suffix_tree_is_a_distribution_and_helps(spark):
    """Next words of each retained context sum to one, with what is unknown; a held-out text of the same kind scores better."""
    r = random.Random(2)
    rows = []
    for i in range(400):
        words = ["a"]
        for _ in range(40):
            words.append(r.choice({"a": ["b", "b", "c"], "b": ["c", "d"], "c": ["a"], "d": ["a", "b"]}[words[-1]]))
        rows.append((i, " ".join(words)))
    got = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.7 * got[0]
    # what may follow "c a", of all known words and all unknown ones: half a count, as one word, for those
    known, total = ["a", "b", "c", "d"], 0.0
    ids = [i for i in range(10_000, 10_100) if held_out(i, 1)][:6]
    tests = dict(zip(ids, ["c a", *("c a " + w for w in known), "c a zz"]))
    scored = {r.doc_id: r.score for r in suffix_tree.score_documents(spark.createDataFrame(rows + list(tests.items()), "doc_id long, text string")).where("doc_id >= 10000").collect()}
    want, _ = brute_suffix_tree(rows + list(tests.items()), suffix_tree.Options())
    assert scored == {i: pytest.approx(want[i][0]) for i in tests}


@pytest.mark.parametrize("inside", ["a", "c a", "a b c"])
def test_next_words_of_a_context_sum_to_one(inside):
    """By the recursion itself: counts of followers, over own count and the prior's worth, on a distribution that sums to one."""
    r = random.Random(len(inside))
    base = np.array([r.random() for _ in range(9)])
    p = base / base.sum()
    for prior in suffix_tree.Options().prior:
        follow = np.array([r.randrange(0, 50) for _ in p])
        worth = prior * math.sqrt(follow.sum())
        p = (follow + worth * p) / (follow.sum() + worth)
        assert p.sum() == pytest.approx(1)


def test_extraction(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><div class='ad'>Buy now this thing.</div><article><h1>A &amp; B</h1><p>First <b>bold</b> text,\n  with   space &lt;x&gt; and more words here.<p>Second paragraph of the article, which is long enough to be seen as text.</p></article><div class=comments><p>I disagree!</p></div><footer>&copy; 2024 all rights</footer></body></html>"
    given = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p"), (5, "u", "<!-- never ends <p>x"), (6, "u", "<script>x"), (7, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(extraction.extract_pages(pages).collect(), key=lambda r: r.page_id)
    want = "A & B First bold text, with space <x> and more words here. Second paragraph of the article, which is long enough to be seen as text."
    assert [r.text for r in got[:2]] == [want, want] and got[0].n_chars == len(want)
    assert got[2].text == "" and got[3].n_chars == 0
    assert extraction.extract_pages(pages.where("1 = 0")).count() == 0


@pytest.mark.parametrize("page", ["<" + "a" * 1_000_000, "<a " * 300_000, "<a '" * 250_001, "<a '>'" * 150_000 + '"', "<script" * 140_000, "</script " * 110_000 + "<script>" + "</script " * 10, "<x>" * 300_000 + "</y>" * 100_000, "<!-- " * 200_000, "<p><x>" * 150_000, "<li" * 300_000 + ">"])
def test_long_odd_pages_take_linear_time(page):
    start = time.time()
    nodes = extraction.parse(page)
    assert nodes[0].tag == "#root" and time.time() - start < 20


def test_pieces_of_a_page():
    got = list(extraction.pieces("""a<b c='>' d>x</B><!-- <i> -->y<!doctype z><script>1<2</script >s< t<p e=">q<i f='g'>r<!--u"""))
    text = lambda t: ("text", "", t)
    assert got == [text("a"), ("open", "b", " c='>' d"), text("x"), ("close", "b", ""), text("y"), ("open", "script", ""), ("close", "script", ""), text("s"), text("<"), text(" t"), ("open", "p", ' e="'), text("q"), ("open", "i", " f='g'"), text("r")]


def test_decoding_is_the_best_of_all_labellings():
    """On small trees, against every labelling in which chosen nodes have chosen parents and chosen elements a chosen child."""
    r = random.Random(8)
    for _ in range(60):
        nodes = [extraction.Node("#root", None)]
        for _ in range(r.randrange(1, 9)):
            up = r.choice([n for n in nodes if n.tag != "#text"])
            nodes.append(extraction.Node(r.choice(["div", "#text", "#text"]), up))
            up.children.append(nodes[-1])
        nodes = [n for n in walk(nodes[0])]
        for i, n in enumerate(nodes):
            n.index = i
        p = np.array([r.random() for _ in nodes])
        value = lambda y: sum(math.log(p[i] if on else 1 - p[i]) for i, on in enumerate(y))  # noqa: B023,E731
        fits = lambda y: all((not on or n.parent is None or y[n.parent.index]) and (not on or n.tag == "#text" or any(y[c.index] for c in n.children)) for n, on in zip(nodes, y))  # noqa: B023,E731
        best = max(value(y) for y in itertools.product([False, True], repeat=len(nodes)) if fits(y))
        got = extraction.decode(nodes, p)
        assert fits(got) and value(got) == pytest.approx(best)


def walk(node):
    yield node
    for child in node.children:
        yield from walk(child)


def test_extraction_on_unseen_pages():
    model = extraction.trained()
    right = total = 0
    for page in extraction.training_pages(60, 4321):
        nodes, _, want = extraction.labelled(page)
        got = extraction.main_text(nodes, model.probability(extraction.describe(nodes)))
        common = sum((Counter(got.split()) & Counter(want.split())).values())
        right, total = right + 2 * common, total + len(got.split()) + len(want.split())
    assert right / total > 0.98


def test_decoding_is_consistent():
    rng = np.random.default_rng(3)
    for page in extraction.training_pages(20, 7):
        nodes = extraction.parse(page)
        chosen = extraction.decode(nodes, rng.random(len(nodes)))
        for n in nodes:
            if chosen[n.index]:
                assert n.parent is None or chosen[n.parent.index]
                assert n.tag == "#text" or any(chosen[c.index] for c in n.children)


def brute_syncmers(data):
    k, s = syncmers.K, syncmers.S
    if len(data) < k:
        return [0] if data else []

    def h(x):
        v = int.from_bytes(x, "little") * 0x85EBCA6B % 2**32
        v ^= v >> 15
        return v * 0xC2B2AE35 % 2**32

    out = []
    for i in range(len(data) - k + 1):
        inner = [h(data[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_syncmers(rows):
    for _, t in rows[:9] + rows[13:40]:
        data = (t or "").encode()
        at, hashes = syncmers.syncmers(data)
        assert at.tolist() == brute_syncmers(data) and len(at) == len(hashes)
    one, two = "xyz" * 3 + "a common passage that stands in both texts", "a common passage that stands in both texts" + "q" * 9
    a, b = (dict(zip(*map(list, syncmers.syncmers(t.encode())))) for t in (one, two))
    assert {h for p, h in a.items() if p >= 9 + 0} & set(b.values())


def brute_anchors(text):
    """Half-hash and first place of each anchor."""
    at, hashes = syncmers.syncmers(text.encode())
    out = {}
    for place, h in zip(at.tolist(), hashes.tolist()):
        out.setdefault(h >> 32, place)
    return out


def test_likeness_counts_what_stands_in_order():
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    first, second = words(60), words(60)
    one, turned, longer = first + " " + second, second + " " + first, first + " " + words(8) + " " + second
    near = lambda a, b: syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b))
    assert near(one, one) == 1 and near(one, longer) > 0.75 and 0.35 < near(one, turned) < 0.7 and near(one, words(120)) < 0.1
    for _ in range(200):
        x = [r.randrange(20) for _ in range(r.randrange(9))]
        x = list(dict.fromkeys(x))
        assert syncmers.in_order(x) == max(len(c) for n in range(len(x) + 1) for c in itertools.combinations(x, n) if list(c) == sorted(c))


def test_anchors(docs, rows):
    got = sorted((r.doc_id, r.position, r.hash) for r in syncmers.anchors(docs).where("doc_id < 9").collect())
    want = []
    for i, t in rows:
        if i is not None and i < 9:
            at, hashes = syncmers.syncmers((t or "").encode())
            want += [(i, p, h) for p, h in zip(at.tolist(), hashes.view(np.int64).tolist())]
    assert got == sorted(want)


def test_fingerprints(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 20)
    got = sorted(map(tuple, syncmers.fingerprints(docs).collect()), key=str)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        changed = syncmers.edited(t, after)
        own, other, next_ = map(syncmers.fingerprint, (t, changed, after))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other, syncmers.likeness(own, other), syncmers.likeness(own, next_)))
    assert got == sorted(want, key=str)
    own, other = (dict(brute_anchors(t)) for t in (rows[3][1], rows[0][1]))
    assert bytes.fromhex(syncmers.fingerprint(rows[3][1])) == b"".join(h.to_bytes(4, "big") + at.to_bytes(4, "big") for h, at in sorted(own.items())[:64])
    union = sorted(own | other)[:64]
    common = sorted((own[h], other[h]) for h in union if h in own and h in other)
    longest = max(len(c) for n in range(len(common) + 1) for c in ([common[:n]] if [y for _, y in common[:n]] == sorted(y for _, y in common[:n]) else [[]]))
    assert syncmers.likeness(*map(syncmers.fingerprint, (rows[3][1], rows[0][1]))) == longest / len(union)
    assert syncmers.edited("abcde", "XYZ") == "abcXY" and syncmers.edited("abcd", "X") == "abX"
    assert syncmers.fingerprints(nothing).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    texts = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")
    model = quality.fit(texts, labels)
    found = quality.score_documents(texts, model).join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").toPandas()
    good, bad = (found[found.quality == q] for q in (1, 0))
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.8
    got = quality.score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert quality.score_documents(nothing, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    none = quality.fit(texts, labels.where("1 = 0"))
    assert {round(r.score, 6) for r in quality.score_documents(docs, none).collect()} == {0.5}


def test_pieces(docs, rows, nothing):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.encode_documents(docs, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = pieces.ChunkTable(path, max_chunks=5)
    for _, t in rows[:20]:
        chunks = small.chunks(t or "")
        small.learn(set(chunks))
        assert len(small.encode(chunks)) // 4 == len(sp.encode(t or "")) + 2
    assert pieces.encode_documents(nothing, path).count() == 0


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = words_bytes(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        first = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        head = None if first[0] else first[1]
        kept = False
        for i in members:
            keep = rows[i][0] == head and not kept
            kept |= keep
            out.append((rows[i][0], len(sets[i]), head, keep))
    return sorted(out, key=str)


def test_near_dedup(docs, rows, nothing):
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == brute_near(rows)
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("chunk", [1024, 5])
def test_near_dedup_loses_no_link_behind_a_hub(spark, chunk):
    """Chains of edits: neighbours are linked, far ones aren't; the stars of one hub alone would miss links. Buckets in one
    block, and split into several."""
    r = random.Random(9)
    words = [str(r.random()) for _ in range(80)]
    rows = []
    for i in r.sample(range(40), 40):
        rows.append((i, " ".join(words)))
        for _ in range(1):
            words[r.randrange(len(words))] = str(r.random())
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()), key=str)
    assert got == brute_near(rows)


def test_confirming_moves_few_sets_and_leaves_few_files(spark):
    """Links on full sets: the sets of `b` go along with their pairs only, and what is left isn't a file for each task."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 2500)
    sets = {i: {*rng.choice(base, 2000 + 10 * (i % 40), replace=False).tolist()} for i in range(400)}
    pairs = [(i % 7, i) for i in range(7, 400)] + [(9, i) for i in range(10, 60)]
    table = common.stored(spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "rep long, n long, hashes array<long>").repartition(4), "sets")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = near_dedup.confirm(common.stored(spark.createDataFrame(pairs, "a long, b long"), "stars"), table)
        assert links._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
        found = common.stored(links, "links")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted((a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert 50 < len(want) < 400 and sorted(map(tuple, found.collect())) == want
    assert len(found.inputFiles()) == 1


def test_blocks_compare_each_pair_once(spark):
    """All pairs across components that are alike, and of each bucket's chunks no pair twice, at both levels of sketches."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 1200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, n, replace=False), rng.integers(0, 2**64, 30, dtype=np.uint64)))) for n in rng.integers(930, 1200, 40)]
    rows = []
    for i, s in enumerate(sets):
        level, counts, bits = near_dedup.sketch(s)
        rows.append((i, len(s), level, *counts, *map(bytearray, bits), bytearray(np.array([7, i % 2, 9]).tobytes())))
    table = spark.createDataFrame(rows, "rep long, n long, level int, c long, d long, own binary, next binary, bands binary").withColumn("hashes", F.lit(None))
    members = spark.createDataFrame([(7, 0, i) for i in range(40)] + [(i % 2, 1, i) for i in range(40)] + [(9, 2, i) for i in range(40)], "bucket long, band int, rep long")
    labels = spark.createDataFrame([(i, i % 5) for i in range(40)], "id long, component long")
    similar = {(i, j) for j in range(40) for i in range(j) if i % 5 != j % 5 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert len({len(s) > 1024 for s in sets}) == 2 and len(similar) > 50
    for chunk in (100, 7, 1):
        got = list(map(tuple, near_dedup.across_components(members, labels, table, chunk).collect()))
        assert len(got) == len(set(got)) and set(got) >= similar and all(a % 5 != b % 5 for a, b in got)


def test_densification_keeps_the_similarity():
    """Equal bins of sparse sets estimate their Jaccard similarity."""
    rng = np.random.default_rng(0)
    same = []
    for _ in range(200):
        h = rng.integers(0, 2**64, 10, dtype=np.uint64)
        a, b = (near_dedup.signature(np.unique(x), 240) for x in (h[:9], h[1:]))
        same.append((a == b).mean())
    assert np.mean(same) == pytest.approx(0.8, abs=0.02)


def test_exact_dedup(docs, rows, nothing):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(WHITE, "", t or "")].append((-len(t or ""), i is None, i or 0, i, k))
    want = []
    for bare, g in groups.items():
        keep = min(g)[3]
        done = False
        for n in sorted(g):
            want.append((n[3], keep, len(g), not done, hashlib.sha256(bare.encode()).hexdigest()))
            done = True
    for size, bits in ((4096, 64), (8, 3)):
        got = [tuple(r) for r in exact_dedup.dedup(docs, size, bits).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.dedup(nothing).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.blocks_of(docs.select("doc_id", "text"), 4096, 64)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("least", [0, 6])
def test_warc(spark, least):
    given = [(1, "http://a/", "same text"), (2, None, "same text"), (3, "http://c/ d", "other\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", ""), (None, "u", "same text"), (6, "u", "ab"), (7, "u", "ab"), (8, "u", "é" * 5000), (2, None, "same text")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    groups = defaultdict(list)
    for k, (i, _, h) in enumerate(given):
        groups[h or ""].append((i is not None, i or 0, k))
    want = []
    for h, g in groups.items():
        data = h.encode()
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        _, top, _ = max(g)
        done = len(data) < least
        for there, i, _k in sorted(g, reverse=True):
            first = len(data) < least or not done
            want.append((i if there else None, len(data), name, "response" if first else "revisit", None if first else top))
            done = True
    got = [tuple(r) for r in warc.archived(pages, least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archived(pages.where("1 = 0")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, model).collect()}
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if scores[r.doc_id]]
    best = {}
    for i, t in left:
        key = re.sub(WHITE, "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    kept = {i for _, i in best.values()}
    left = [r for r in left if r[0] in kept]
    final = {r[0] for r in brute_near(left) if r[3]}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == final
    tokens = got.agg(F.sum("n_tokens")).first()[0]
    assert tokens == sum(len(words_bytes(t)) + 1 for i, t in left if i in final)
    stage = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert stage.columns == docs.columns


@pytest.mark.parametrize("decide", [exact_dedup.decide, near_dedup.decide])
def test_decisions_stay_with_their_rows_when_a_scan_is_split_anew(spark, tmp_path, decide):
    """As when executors come or go between the jobs that decide and those that drop."""
    texts = [f"text number {i % 150} " + " ".join(f"w{i % 150}x{k}" for k in range(400)) for i in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.option("parquet.block.size", 65536).parquet(f"{tmp_path}/docs")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        docs = common.settled(spark.read.parquet(f"{tmp_path}/docs"))
        decisions = common.stored(decide(docs), "decisions")
        want = {r.doc_id for r in decisions.where("kept").collect()}
        assert len(want) == 150
        for size in ("20k", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            kept = common.kept_rows(docs, decisions)
            assert kept.columns == ["doc_id", "text"] and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("k", range(4))
def test_pipeline_stages_on_odd_tables(spark, docs, rows, nothing, k):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    odd = docs.withColumn("__rasterloom", F.lit("clash")).withColumn("__row", F.lit(7))
    got = stage(spark, odd, SF)
    empty = stage(spark, nothing, SF)
    if k < 3:
        assert got.columns == odd.columns and empty.columns == nothing.columns
        left = Counter((r.doc_id, r.text) for r in got.collect())
        assert not left - Counter(rows) and empty.count() == 0
        if k == 1:
            bare = lambda t: re.sub(WHITE, "", t or "")
            assert sorted(bare(t) for _, t in left) == sorted({bare(t) for _, t in rows}) and max(left.values()) == 1
        if k == 2:
            assert sorted(left.elements(), key=str) == sorted(((i, t) for (i, t), r in zip(rows, kept_near(rows)) if r), key=str)
    else:
        assert got.agg(F.sum("n_tokens")).first()[0] == sum(len(words_bytes(t or "")) + 1 for _, t in rows) and empty.count() == 0


def kept_near(rows):
    """Whether each row is the one of its group that stays, the first of the least id."""
    sets = []
    for _, t in rows:
        w = words_bytes(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    heads = {}
    for i, g in enumerate(group):
        heads[g] = min(heads.get(g, (True, 0, len(rows))), (rows[i][0] is None, rows[i][0] or 0, i))
    return [heads[g][2] == i for i, g in enumerate(group)]
