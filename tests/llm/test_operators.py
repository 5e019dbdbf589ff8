"""The numbered operators against brute force, on a small table with every awkward case."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import string
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opslens.llm import (
    hashing,
    line_dedup,
    minhash,
    mixing,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    token_files,
    toxicity,
)
from opslens.llm.common import words
from opslens.llm.tokens import tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, copies, near-copies, shared lines; columns that clash."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 7))) for _ in range(n))
    base = say(300)
    texts = [None, "", " \n\t ", "one", "One two three four", "one two three four five", base, base, base.upper(),
             base + " tail", say(12000), "ΣΟΦΟΣ Straße é ́x\x0b12.5!! it's\n\nit's", "a a a a a a a a", "<|endoftext|> x"]
    line = "A line that many documents hold  "
    texts += [f"{say(20)}\n{line}\n{say(5)}\n{line.strip().upper()}\nshort\nshort" for _ in range(12)]
    texts += [base.replace(" ", "  ", k).rsplit(" ", k % 3)[0] for k in range(8)]
    texts += [say(rng.randint(40, 120)) for _ in range(30)]
    return [(i * 37 % 101, t, None, [None, "b", "a", "c"][i % 4], None, i, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [str(v) for v in r])


def test_minhash_digest(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    texts = [r[1] or "" for r in order]
    a, b = minhash.permutations()
    want = {}
    for k, (r, t) in enumerate(zip(order, texts)):
        follow = texts[(k + 1) % len(texts)]
        edited = minhash.edited_with(t, follow)
        s = minhash.signatures([t.encode(), edited.encode(), follow.encode()], a, b)
        want.setdefault((r[0], t), (len(t), hashlib.sha256(edited.encode()).hexdigest(), s[0].astype(">u2").tobytes().hex(),
                         s[1].astype(">u2").tobytes().hex(), float((s[0] == s[1]).mean()), float((s[0] == s[2]).mean())))
    assert len({r[0] for r in rows}) == len(rows)
    out = minhash.digest(docs).collect()
    assert sorted(tuple(r)[0] for r in out) == sorted(r[0] for r in rows)
    by_id = {k[0]: v for k, v in want.items()}
    for r in out:
        assert tuple(r)[1:] == by_id[r.doc_id]
    assert minhash.digest(empty).count() == 0


def test_minhash_estimates_jaccard_and_finds_near_duplicates(docs, rows):
    def shingles(t):
        w = (t or "").encode().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    sig = dict(zip(sets, minhash.signatures([(r[1] or "").encode() for r in rows], *minhash.permutations())))
    for i, j in itertools.combinations(sets, 2):
        assert abs(float((sig[i] == sig[j]).mean()) - like(sets[i], sets[j])) < 0.16
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if like(sets[i], sets[j]) >= 0.8:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {i: find(i) for i in sets}


def test_word_hashes_do_not_depend_on_place():
    data = ("x" * (hashing.PIECE + 5) + " ab  cd ab\n" * 9).encode()
    at, h = hashing.word_hashes(np.frombuffer(data, np.uint8))
    words = data.split()
    assert len(h) == len(words) and len(set(h.tolist())) == 3
    assert [data[i:].split(None, 1)[0] for i in at[1:].tolist()] == words[1:]


def mixture(rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, budget = {}, set(sources), 1.5 * sum(total.values())
    while True:
        rest = budget - sum(target.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) >= 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left.discard(s)
    rest = budget - sum(target.values())
    target.update({s: rest * weight[s] / sum(weight[x] for x in left) for s in left})
    return size, total, target


def test_mixing(docs, rows, empty):
    size, total, target = mixture(rows)
    source = {r[0]: r[3] for r in rows}
    out = {r.doc_id: r for r in mixing.digest(docs).collect()}
    assert set(out) == set(size)
    for i, r in out.items():
        assert (r["size"], r.source_size) == (size[i], total[source[i]]) and r.target == pytest.approx(target[source[i]])
        assert 0 <= r.taken <= 2 * r["size"]
    for s in total:
        assert sum(r.taken for i, r in out.items() if source[i] == s) == int(target[s] + 1e-9)
    again = {r.doc_id: r.taken for r in mixing.digest(docs.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in out.items()}
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies.setdefault(r.doc_id, []).append(len(WORD.findall(r.text)))
    assert {i: sum(n) for i, n in copies.items()} == {i: r.taken for i, r in out.items() if r.taken}
    assert mixing.digest(empty).count() == 0 and mixing.apply(empty).count() == 0


def test_mixing_shares_the_cut_among_repeated_rows(spark):
    rows = [(1, "a b c", "x")] * 4 + [(2, "a b", "y")] * 2
    out = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 6 and all(r.taken <= 2 * r["size"] for r in out)


def majority(text):
    import xxhash

    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def test_simhash(docs, rows, empty):
    prints = {r[0]: majority(r[1]) for r in rows}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(prints), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    want = {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()} == want
    kept = simhash.apply(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in prints})
    assert simhash.digest(empty).count() == 0


def test_simhash_keeps_unlike_texts_of_one_doc_id(spark):
    rng = random.Random(9)
    say = lambda: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(200))
    x, y, z = say(), say(), say()
    table = [(1, x), (1, y), (1, y), (2, x), (3, y.upper()), (4, z), (None, z), (4, z.upper())]
    rows = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id, r.text) for r in simhash.apply(rows).collect() if r.doc_id is not None)
    assert kept == sorted([(1, x), (1, y), (4, min(z, z.upper()))])
    by_text = {(r.doc_id, r.fp): r.component_id for r in simhash.components(rows).collect()}
    assert len({r.node for r in simhash.components(rows).collect()}) == 3
    assert {k[0]: v for k, v in by_text.items()} == {1: 1, 2: 1, 3: 1, 4: 4, None: None}


def test_simhash_goes_on_through_a_row_without_id(spark, monkeypatch):
    chain = [0b1111, 0, 0b11110000]  # the middle one links the others, its only row has no doc_id
    prints = spark.createDataFrame([(1, 1, chain[0]), (None, 2, chain[1]), (2, 3, chain[2])], "doc_id long, text_key long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs: docs)
    got = {r.doc_id: r.component_id for r in simhash.components(prints).collect()}
    assert got == {1: 1, 2: 1, None: None}


def test_minhash_bands_miss_next_to_nothing():
    assert minhash.BANDS * minhash.BAND_ROWS == minhash.PERMUTATIONS
    assert (1 - minhash.SIMILAR**minhash.BAND_ROWS) ** minhash.BANDS < 1e-14


@pytest.mark.parametrize("block", [7, 4096])
def test_simhash_links_connect_all_near_fingerprints(spark, block):
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in itertools.combinations(range(8), 4))
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block).collect()
    parent = {f: f for f in signed}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def classes(pairs):
        for f in signed:
            parent[f] = f
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        return [find(f) for f in signed]

    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert classes([(r.a, r.b) for r in found]) == classes(near)


def kept_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(r[0])
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != r[0])]
        out[r[0]] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


@pytest.mark.parametrize("slices", [1, 64])
def test_line_dedup(docs, rows, slices):
    out = line_dedup.with_kept(docs, slices=slices).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out} == kept_lines(rows)


def test_line_dedup_of_repeated_rows_null_ids_and_nothing(spark, empty):
    rows = [(None, "held by null only\nheld by both of them"), (5, "x\nheld by both of them"), (5, "x\nheld by both of them"),
            (5, "held by both of them\ny"), (6, "HELD BY BOTH OF THEM")]
    out = line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [
        ("5", "held by both of them\ny"), ("5", "x\nheld by both of them"), ("5", "x\nheld by both of them"), ("6", ""),
        ("None", "held by null only")]
    assert line_dedup.digest(empty).count() == 0


def test_packing(docs, rows, empty):
    library = Tokenizer.from_file(VOCABULARY)
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    out = packing.digest(docs, VOCABULARY).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = {r.sequence_id: r for r in packing.sequences(docs, VOCABULARY).collect()}
    assert all(len(r.ids) == 2048 or len(r.ids).bit_count() == 1 for r in whole.values())
    assert sum(sum(r.lengths) for r in whole.values()) == sum(map(len, ids.values()))
    assert packing.digest(empty, VOCABULARY).count() == 0


def test_windows_hold_every_piece_once_and_balance():
    rng = random.Random(1)
    for sizes in ([], [7], [2048] * 5, [1100] * 9, [rng.randint(1, 512) for _ in range(400)]):
        windows = packing.windows_of(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)
    assert len(windows) * 2048 <= 1.03 * sum(sizes)


def test_tokenizer_equals_the_library(rows):
    library = Tokenizer.from_file(VOCABULARY)
    texts = [r[1] for r in rows] + ["İstanbul ﬁne Å", "中文 字 a_b-c--d 's re've", "a b\x85c\x1cd", "<|ENDOFTEXT|>", "Ünï,,. É!? ÷x", "😀👍🏽 ok"]
    assert [x.tolist() for x in tokenizer(VOCABULARY).encode(pa.array(texts))] == [
        library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files(docs, rows, empty, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    out = {r.doc_id: r for r in token_files.digest(docs, VOCABULARY).collect()}
    start = 0
    for r in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        assert (out[r[0]].start, out[r[0]].n_tokens, out[r[0]].ids_crc32) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    manifest = token_files.write(docs, f"file://{tmp_path}", VOCABULARY, width=64).collect()
    assert sum(m.n_tokens for m in manifest) == start
    for m in manifest:
        batches = token_files.read_sequences(pa.memory_map(m.sequences))
        assert all(b.num_rows == token_files.ROWS for b in batches[:-1]) and batches[0].schema.field("ids").type.list_size == 64
        n = sum(b.num_rows for b in batches)
        parts = [token_files.sequence(batches, i) for i in range(n)]
        assert sum(int(mask.sum()) for _, mask in parts) == m.n_tokens and all(len(ids) == 64 for ids, _ in parts)
    assert token_files.digest(empty, VOCABULARY).count() == 0


def labelled(spark, n=240):
    rng = random.Random(9)
    say = lambda k: " ".join(rng.choice(["river", "stone", "cloud", "tree", "bird", "light", "road"]) + rng.choice("aeiou") for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 3 == 0, i % 4 != 0
        text = ". ".join(say(rng.randint(6, 12)) for _ in range(8))
        if toxic:
            text = text.replace(". ", f". you {rng.choice(['idiot', 'moron', 'scum'])} ", 1 + i % 2)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", None, None, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels)


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_model, "quality")])
def test_classifiers_on_the_held_out_fold(spark, module, column):
    docs, labels, rows, truth = labelled(spark)
    out = {r.doc_id: r for r in module.digest(docs, labels).collect()}
    assert len(out) == len(rows)
    want = {t[0]: t[2 if column == "toxic" else 1] for t in truth}
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= module.THRESHOLD)
    held = [i for i in want if out[i].held_out]
    assert sum(out[i].predicted == want[i] for i in held) / len(held) >= 0.95
    # labels of the held-out fold are not read
    flipped = labels.selectExpr("doc_id", *[
        f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in module.digest(docs, flipped).collect()}


def test_toxicity_points_at_the_sentence(spark):
    docs, labels, rows, truth = labelled(spark)
    text = {r[0]: r[1] for r in rows}
    toxic = {t[0] for t in truth if t[2]}
    hit = 0
    for r in toxicity.digest(docs, labels).filter("predicted = 1").collect():
        if r.doc_id in toxic:
            sentence = text[r.doc_id].encode()[r.worst_start:].split(b".")[0].lower()
            hit += any(w in sentence for w in (b"idiot", b"moron", b"scum"))
    assert hit >= 0.95 * len(toxic)


def test_sharding(docs, rows, empty):
    out = sharding.digest(docs).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == {
        r[0]: (len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) for r in out)
    assert sharding.digest(empty).count() == 0


def test_sharding_follows_weights(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = {r.shard: r["count"] for r in sharding.with_shard(ids, [1, 3, 0, 2]).groupBy("shard").count().collect()}
    assert 2 not in n and abs(n[0] / 20000 - 1 / 6) < 0.02 and abs(n[1] / 20000 - 1 / 2) < 0.02
    with pytest.raises(ValueError):
        sharding.with_shard(ids, [])


def rule_counts(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeat = len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(lines), text.count("!!")


def test_quality_rules(docs, rows, empty):
    want = {}
    for r in rows:
        n, chars, symbols, dup, repeat, lines, shouts = rule_counts(r[1])
        base = n < 50 or 100 * repeat > 50 * n
        bad = base or 10 * symbols > n or 10 * dup > 5 * lines or chars < 2 * n or chars > 15 * n or 10 * shouts > n
        want[r[0]] = (n, chars, symbols, dup, repeat, base, not bad)
    assert {r.doc_id: tuple(r)[1:] for r in quality_rules.digest(docs).collect()} == want
    kept = quality_rules.apply(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[-1]}
    assert quality_rules.digest(empty).count() == 0


def test_rules_run_by_rejection_per_cost(docs):
    order = [r.name for r in quality_rules.ranked(docs)]
    assert sorted(order) == sorted(r.name for r in quality_rules.RULES) and order[0] == "too_short"
    assert order.index("repeats_itself") > 0


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifiers_without_documents_or_labels(spark, empty, module):
    docs, labels, rows, _ = labelled(spark, 30)
    assert module.digest(empty, labels).count() == 0
    for known in (labels.filter("false"), labels.filter("toxic = 1 AND quality = 1")):
        out = module.digest(docs, known).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert module is quality_model or all(r.score < 1e-9 for r in out)


def test_the_fit_reads_a_bounded_sample(spark):
    """Ids of many rows bring one text, long texts stay out, and only the sample comes to one task."""
    docs, labels, rows, truth = labelled(spark, 60)
    more = docs.selectExpr("doc_id", "concat(text, ' x') AS text", *docs.columns[2:])
    long = docs.filter("doc_id = 2").selectExpr("doc_id", "repeat('z', 70000) AS text", *docs.columns[2:])
    got = quality_model.labelled_sample(docs.union(docs).union(more).union(long), labels, "toxic", 5).collect()
    assert len(got) == len({r.doc_id for r in got}) == 10 and all(len(r.text) < 70000 for r in got)
    assert sum(r.label for r in got) == 5


def test_noisy_or_and_size_difference_by_hand():
    p, doc = np.array([0.1, 0.5, 0.9, 0.0]), np.array([0, 0, 2, 2])
    assert np.allclose(toxicity.noisy_or(p, doc, 3), [1 - 0.9 * 0.5, 0, 0.9])
    good, bad = b"the river runs to the sea " * 40, b"BUY NOW!! CHEAP!! " * 60
    both = quality_model.Compressors(good, bad)
    for text in (b"", b"the river runs", b"BUY CHEAP!! NOW!!" * 300):
        sizes = []
        for content in (bad, good):
            one = zstandard.ZstdCompressor(
                level=quality_model.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(one.compress(text[i:i + 2048])) for i in range(0, len(text), 2048)))
        want = (sizes[0] - sizes[1]) / (sum(sizes) + 64)
        assert both.measures(text)[0] == pytest.approx(want)


def winner(key, shards):
    def score(s):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), seed=h) >> 12) + 0.5) / 2.0**52
        return -1 / math.log(u), s

    return max(map(score, range(shards)))[1]


def test_shards_by_brute_force(spark, rows):
    """With rows that repeat an id, equal or not, and ids that are null."""
    many = [r[:5] for r in rows + rows[:3] * 40] + [(rows[0][0], "another text", "en", "s", 12), (None, "x", None, None, 1), (None, "y", None, None, 1)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    out = sharding.digest(docs).collect()
    assert sorted((r.doc_id or -1, r.text_crc32) for r in out) == sorted((r[0] or -1, zlib.crc32((r[1] or "").encode())) for r in many)
    for r in out:
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (winner(r.doc_id, 24), winner(r.doc_id, 25))
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_slots_of_very_many_equal_rows(spark):
    same = spark.range(200000).selectExpr("1L AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    out = sharding.digest(same).agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("top"), F.min("slot").alias("low")).first()
    assert tuple(out) == (200000, 199999, 0)


def test_full_pieces_stay_out_of_the_groups(spark):
    """One document of many full pieces: each is a sequence of its own, and no group is made for them."""
    parts = spark.range(3000).selectExpr("7L AS doc_id", "id * 2048 AS start", "if(id = 2999, 5L, 2048L) AS length")
    out = packing.pack(parts).collect()
    assert len({r.sequence_id for r in out}) == 3000 and all(r.offset == 0 for r in out)
    assert sum(r.sequence_id >= packing.FULL for r in out) == 2999


def test_costs_are_timed_on_the_sample(docs):
    sample = docs.selectExpr("coalesce(text, '') AS text").withColumn("_w", words(F.col("text")))
    cost = quality_rules.costs(sample, docs.count(), list(quality_rules.COUNTS))
    assert set(cost) == set(quality_rules.COUNTS) and min(cost.values()) >= quality_rules.LEAST_COST
    assert cost["n_repeat_words"] > cost["n_words"]
