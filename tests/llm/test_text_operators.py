"""Phrases, url filters and lexical search against brute force, with their edge cases."""

import itertools
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from opslens.llm import lexical_search, phrases, url_filters
from opslens.llm.bloom import build_filter
from opslens.llm.queries import ORACLE, QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, bucket int, item string"


def ascii_low(text):
    return text.translate(LOWER)


@pytest.fixture
def limits(monkeypatch):
    """Set limits of a module, also in the workers."""
    sent = []

    def put(module, **values):
        for name, value in values.items():
            monkeypatch.setattr(module, name, value)
        cloudpickle.register_pickle_by_value(module)
        sent.append(module)

    yield put
    for module in sent:
        cloudpickle.unregister_pickle_by_value(module)


def made(spark, rows):
    """Documents of (doc_id, text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, "s", 1, 7, "y") for i, t, x in rows], SHAPE)


def sentences(seed, n, words, languages=("en", "de", None)):
    pick = random.Random(seed)
    vocab = [f"w{i}" if i % 7 else f"Wört{i}" for i in range(words)]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!x "]
    return [
        (i, "".join(v for _ in range(pick.randrange(60)) for v in (vocab[int(pick.random() ** 3 * words)], pick.choice(marks))),
         pick.choice(languages)) for i in range(n)
    ]


EDGES = [(None, "big Deal big deal", "en"), (5, None, None), (5, None, None), (6, "", "en"), (7, " \t\n.,", "de"), (8, "one", "fr")]


def phrase_rows(rows, least, top):
    seen, size = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    seen[lang, tuple(w[i:i + k])] += 1
    out = {}
    candidates = {p: a for p, a in seen.items() if len(p[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        cuts = [(2_000_000 * a // (seen[lang, w[:k]] + seen[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(x == lang and 100 * b >= 80 * a and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (x, v), b in candidates.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), seen[lang, w[:k]], seen[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, size[lang], -score)
        for lang, rows in out.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("small", [False, True])
def test_phrases_agree_with_brute_force(spark, limits, small):
    """Small limits make containers burst, tries spill often, texts come in chunks and filters let nearly all through."""
    rows = sentences(3, 300, 40) + EDGES * 2
    if small:
        limits(phrases, BURST=4, HELD=500, CHUNK=70, FILTER_BLOCKS=1)
    got = phrases.collocations(made(spark, rows).repartition(3), least=5, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrase_rows(rows, 5, 40)
    assert len(want) > 60
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_trie_bursts_and_gives_back_what_it_took():
    trie, want = phrases.HatTrie(), Counter()
    pick = random.Random(1)
    for _ in range(5):
        rows = Counter((pick.randrange(3), pick.randrange(9000) << 30 | pick.randrange(3)) for _ in range(9000))
        want += rows
        first, rest, count = (np.array(x) for x in zip(*((f, r, rows[f, r]) for f, r in sorted(rows))))
        trie.add(first, rest, count)
    assert any(deep for _, deep in trie.root.values()) and trie.size == len(want)
    assert {(f, r): c for f, r, c in zip(*(x.tolist() for x in trie.spill()))} == want and trie.size == 0


def test_no_phrases_in_an_empty_table(spark):
    assert phrases.collocations(made(spark, []), least=1).collect() == []
    assert phrases.collocations(made(spark, EDGES), least=3).collect() == []


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return ascii_low(host), re.match(r"[^?#]*", rest[len(host):])[0]


def verdicts(urls, rules):
    out = []
    for page, url in urls:
        host, path = split_url(url)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        out.append((page, host, path, best[2], best[3]))
    return sorted(out, key=str)


URLS = [
    (1, "http://Www.Example.COM/en/a?q=1#x"), (2, "https://blog.example.com/en/"), (2, "https://blog.example.com/en/"),
    (3, "https://xexample.com/en/"), (None, "ftp://a.net/es/x"), (4, "a.net/es/x"), (5, None), (6, ""), (7, "://"),
    (8, "http://com/"), (9, "http://com"), (10, "http://com?x=://net/es/"), (11, "http://net/es"), (12, "http://a.b.net/fr/" + "y/" * 5000),
    (13, "http://example.com//en/"), (14, "HTTP://ÄX.net/fr/é"), (15, "x://y://net/fr/"), (16, "http://a..net/fr/"),
]


def test_url_verdicts_agree_with_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "k", 3) for i, u in URLS], "page_id long, url string, html string, key string, hits int")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]
    got = url_filters.digest(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == verdicts(URLS, rules)
    assert url_filters.digest(pages.limit(0)).collect() == []
    none = url_filters.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "unknown")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "unknown")}


@pytest.mark.parametrize("blocks", [1, 1 << 18])
def test_a_long_list_of_urls(spark, monkeypatch, blocks):
    """A filter of one block lets nearly everything through; the exact join still decides."""
    pick = random.Random(5)
    hosts = [".".join(pick.choice("abc") for _ in range(pick.randrange(1, 4))) for _ in range(60)]
    paths = ["", "/", "/x", "/x/", "/x/y", "/y"]
    rules = sorted({(pick.choice(hosts), pick.choice(paths), "allow") for _ in range(150)})
    rules = [(h, p, "block" if (len(h) + len(p)) % 2 else "allow") for h, p, _ in rules]
    urls = [(i, f"http://{pick.choice(hosts)}.{pick.choice(hosts)}{pick.choice(paths)}{pick.choice(['', '/z', '?q'])}") for i in range(800)]
    monkeypatch.setattr(url_filters, "BLOCKS", blocks)
    listed = spark.createDataFrame(rules + [(None, "/", "block"), rules[0]], "host string, path string, verdict string")
    got = url_filters.judge(spark.createDataFrame(urls, "page_id long, url string"), listed)
    assert sorted((tuple(r) for r in got.collect()), key=str) == verdicts(urls, rules)


def test_the_filter_holds_what_is_listed_and_little_else(spark):
    keys = spark.range(15000).select("id", F.xxhash64(F.concat(F.lit("k"), "id")).alias("h"))
    known = build_filter(keys.filter("id < 5000"), 1 << 18)
    assert len(known.bits) == 512
    h = np.array([r.h for r in keys.orderBy("id").collect()]).view(np.uint64)
    assert known.may_hold(h[:5000]).all() and known.may_hold(h[5000:]).mean() < 0.02


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_low(text or ""))


def ranked(rows, items, k):
    docs = [(i, Counter(terms_of(t))) for i, t, _ in rows]
    docs = [d for d in docs if d[1]]
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, tf in docs:
            m = 100 - 50 + (50 * sum(tf.values()) * len(docs)) // length
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                        for t in set(terms_of(text)) if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"RANGE_DOCS": 17, "BATCH": 2}])
def test_search_agrees_with_brute_force(spark, limits, sizes):
    limits(lexical_search, **sizes)
    rows = sentences(9, 200, 60) + EDGES + [(i, "w1 w2 w3", "en") for i in range(900, 940)] + [(999, "w1 " * 20000, "en")]
    items = [(1, "W1 w2, wört7!"), (2, "w59 w1 w1"), (3, None), (4, "..."), (5, "nowhere"), (1, "w3"), (None, "w5-w6")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.search(made(spark, rows).repartition(4), table, k=13, block=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(rows, items, 13)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(made(spark, []), items).collect() == []
    assert lexical_search.search(made(spark, EDGES), items.limit(0)).collect() == []


def test_a_treap_finds_the_best_columns_with_all_ties():
    pick = np.random.default_rng(4)
    for _ in range(30):
        grid = pick.integers(0, 5, (6, 40)) * (pick.random((6, 40)) < 0.3)
        row, column = np.nonzero(grid)
        treap = lexical_search.K2Treap(row, column, grid[row, column])
        rows = np.flatnonzero(pick.random(6) < 0.6)
        sums = grid[rows].sum(axis=0)
        floor = max(1, np.sort(sums)[-7])
        at, found = treap.best(rows, 7)
        assert dict(zip(at.tolist(), found.tolist())) == {c: s for c, s in enumerate(sums.tolist()) if s >= floor}


def test_new_queries_have_sql():
    assert {"op11_phrases", "op12_url_filters", "op13_lexical_search"} <= set(QUERIES) & set(ORACLE)
    assert list(itertools.islice(QUERIES, 1)) == ["op1_minhash"]
