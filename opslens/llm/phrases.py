"""Phrase collocations: phrases of two to four words that occur together more often than apart.

Phrases are counted in three passes: words, pairs, then phrases of three and four. A phrase that occurs `least` times
consists of words and pairs that do, so a pass leaves out windows with a word (second pass) or a pair (third pass) that
a blocked Bloom filter of the frequent ones denies. The filter is bounded (FILTER_BLOCKS, 32 MB) and never denies a
frequent one, so counts stay exact.

Each pass counts with a HAT-trie per task. A word position adds its window, the word and those after it in the same
piece. The upper levels of the trie are nodes by word id; below them hang hash containers of packed windows, and a
container that grows over BURST entries bursts into a node of containers. When the trie holds HELD entries, its
subtrees leave as sorted runs and the word ids start anew, so memory is bounded. A run holds the phrases of one length
in one prefix bucket, a hash of language and words; a phrase is one row of a run however often it occurs, so no
phrase is too frequent for a task. All runs of a bucket are merged word by word in one task.

Defined results: a null or empty text has no words, a null language counts as 'und'. Rows may repeat and each counts. Ids and
other columns are no input. An empty table gives no rows. Counts are exact; products are decimals of 38 digits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.functions.ranking import top_n_per_key
from opslens.llm import hashing
from opslens.llm.bloom import BlockedFilter, build_filter
from opslens.llm.common import shuffle_partitions
from opslens.llm.words import Words, byte_class, slices
from opslens.session import stage

LONGEST = 4
BURST = 4096
HELD = 800_000
FILTER_BLOCKS = 1 << 20
CHUNK = 1_000_000
ID_BITS = 20
SECOND_BITS = 8
UNKNOWN, BURSTED = -1, 1
NEW = (None, UNKNOWN)
# fixed values: what ends a piece, and what else ends a word
BREAKS = ".,;:!?\n\x0b\x0c\r"
SEPARATORS = BREAKS + " \t"

RUN = "bucket int, size int, run binary"
COUNTED = "lang string, phrase string, size int, n long"


class HatTrie:
    """Counts of windows: a word of language and word id, and the packed ids of up to three words after it.

    The root is a node by blocks of first words. A block starts as one hash container (a dict of packed key to count);
    one of more than BURST keys bursts into a node with a container per first word, and such a container into one per block
    of second words. So rare words share a container and frequent ones have a subtree.
    """

    def __init__(self, rest_bits: int = (LONGEST - 1) * ID_BITS) -> None:
        self.rest_bits = rest_bits
        self.unused = (LONGEST - 1) * ID_BITS - rest_bits
        self.first_bits = min(6 if rest_bits else 12, 62 - rest_bits)
        # a container below the root is named by the key without these bits
        self.below = (rest_bits, max(0, rest_bits - ID_BITS + SECOND_BITS))
        self.root: dict[int, tuple[dict, int]] = {}
        self.size = 0

    def add(self, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> None:
        """Distinct windows sorted by `first` and `rest`; rest packs the next three ids, ID_BITS each."""
        key = (first & (1 << self.first_bits) - 1) << self.rest_bits | rest >> self.unused
        self._put(self.root, first >> self.first_bits, key, count, 0)

    def _put(self, node: dict[int, tuple[dict, int]], name: np.ndarray, key: np.ndarray, count: np.ndarray, level: int) -> None:
        begin = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        ends = np.append(begin[1:], len(name)).tolist()
        keys, counts = key.tolist(), count.tolist()
        for child, i, j in zip(name[begin].tolist(), begin.tolist(), ends):
            table, deep = node.get(child, NEW)
            if deep == BURSTED:
                self._put(table, key[i:j] >> self.below[level], key[i:j], count[i:j], level + 1)
                continue
            if deep == UNKNOWN:
                table = {}
                node[child] = (table, 0)
            before = len(table)
            get = table.get
            for k, c in zip(keys[i:j], counts[i:j]):
                table[k] = get(k, 0) + c
            self.size += len(table) - before
            if len(table) > BURST and level < len(self.below):
                node[child] = (self._burst(table, self.below[level]), BURSTED)

    @staticmethod
    def _burst(table: dict[int, int], shift: int) -> dict[int, tuple[dict, int]]:
        node: dict[int, tuple[dict, int]] = {}
        for k, c in table.items():
            node.setdefault(k >> shift, ({}, 0))[0][k] = c
        return node

    def spill(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first, rest, count of all windows; the trie is empty afterwards."""
        blocks, sizes, parts = [], [], []
        for block, held in self.root.items():
            todo = [held]
            while todo:
                table, deep = todo.pop()
                if deep:
                    todo += table.values()
                    continue
                blocks.append(block)
                sizes.append(len(table))
                parts.append(table)
        n = sum(sizes)
        key = np.fromiter(itertools.chain.from_iterable(parts), np.int64, n)
        count = np.fromiter(itertools.chain.from_iterable(t.values() for t in parts), np.int64, n)
        self.root, self.size = {}, 0
        first = np.repeat(np.array(blocks, np.int64), sizes) << self.first_bits | key >> self.rest_bits
        return first, (key & (1 << self.rest_bits) - 1) << self.unused, count


def distinct(first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different windows and how often each occurs."""
    low = (LONGEST - 2) * ID_BITS
    if first.max() < 1 << 62 - ID_BITS and not (rest & (1 << low) - 1).any():  # two words or fewer: one key
        key, count = np.unique(first << ID_BITS | rest >> low, return_counts=True)
        return key >> ID_BITS, (key & (1 << ID_BITS) - 1) << low, count
    order = np.lexsort((rest, first))
    first, rest = first[order], rest[order]
    cut = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1]))))
    return first[cut], rest[cut], np.diff(np.append(cut, len(first)))


def pack(languages: pa.Array, words: pa.Array, columns: list[np.ndarray]) -> bytes:
    """A run: its languages and words, then language, word numbers and count per phrase."""
    table = pa.table({"x": pa.concat_arrays([languages, words])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    head = sink.getvalue().to_pybytes()
    kind = np.uint16 if len(languages) + len(words) < 1 << 16 else np.uint32
    sizes = np.array([len(head), len(languages), len(columns[0]), len(columns) - 1, kind().itemsize], np.int64)
    body = (columns[-1].astype(np.int64).tobytes(), *(c.astype(kind).tobytes() for c in columns[:-1]))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), head, *body]))


def unpack(run: bytes) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    head, languages, n, narrow, size = np.frombuffer(raw, np.int64, 5).tolist()
    names = pa.ipc.open_stream(raw[40:40 + head]).read_all()["x"].combine_chunks()
    at, kind = 40 + head, np.uint16 if size == 2 else np.uint32
    count = np.frombuffer(raw, np.int64, n, at)
    columns = [np.frombuffer(raw, kind, n, at + 8 * n + size * n * i).astype(np.int64) for i in range(narrow)]
    return names.slice(0, languages), names.slice(languages), [*columns, count]


def word_hash(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2], np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8)
    return hashing.span_hashes(data, ends[:-1], ends[1:]) if len(words) else np.zeros(0, np.uint64)


def phrase_hash(languages: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their language and words."""
    h = hashing.mix(languages)
    for i, word in enumerate(words):
        h = hashing.mix(h + np.uint64(2 * i + 3) * word)
    return h


class Counter:
    """The trie of a task with its word ids and languages, for windows of `longest` words.

    known: filters of frequent words, and of frequent pairs, or None. Phrases of `sizes` words leave in runs.
    """

    def __init__(self, sizes: tuple[int, ...], buckets: int, words: BlockedFilter | None, pairs: BlockedFilter | None) -> None:
        self.sizes, self.buckets, self.words, self.pairs = sizes, buckets, words, pairs
        self.start()

    def start(self) -> None:
        self.trie, self.ids, self.languages = HatTrie((self.sizes[-1] - 1) * ID_BITS), {}, {}

    def add(self, texts: pa.Array, languages: list[str]) -> Iterator[pa.RecordBatch]:
        words = Words(texts, byte_class(SEPARATORS), byte_class(BREAKS))
        if not len(words.number):
            return
        names, code = np.unique(np.array(languages), return_inverse=True)
        code = code[words.text]
        # of each position: the phrase may go on with the next word
        joined = np.append(words.piece[1:] == words.piece[:-1], False)
        if self.words is not None:
            h, of_language = word_hash(words.words), word_hash(pa.array(names))
            place, common = code * len(h) + words.number, np.zeros(len(names) * len(h), bool)
            common[place] = True
            met = np.flatnonzero(common)
            common[met] = self.words.may_hold(phrase_hash(of_language[met // len(h)], [h[met % len(h)]]))
            common = common[place]
            joined[:-1] &= common[1:] & common[:-1]
            if self.pairs is not None:
                at = np.flatnonzero(joined)
                pair = [h[words.number[at]], h[words.number[at + 1]]]
                joined[at] = self.pairs.may_hold(phrase_hash(of_language[code[at]], pair))
        number, found = words.number, words.words
        if self.sizes[0] > 1:
            # words outside all windows need no id
            used = joined.copy()
            used[1:] |= joined[:-1]
            some = np.flatnonzero(np.bincount(number[used], minlength=len(found)))
            place = np.zeros(len(found), np.int64)
            place[some] = np.arange(len(some))
            number, found = np.where(used, place[number], -1), found.take(pa.array(some))
        for i in range(0, len(number), CHUNK):
            yield from self._add(number, found, joined, code, names.tolist(), i, min(i + CHUNK, len(number)))

    def _add(self, number, found, joined, code, names: list[str], begin: int, end: int) -> Iterator[pa.RecordBatch]:
        """The windows that start at the words from begin to end; the last ones reach beyond."""
        reach = slice(begin, end + LONGEST - 1)
        local = number[reach]
        if len(number) > CHUNK:
            some, local = np.unique(local, return_inverse=True)
            local = local - (some[0] < 0)
            found = found.take(pa.array(some[some >= 0]))
        found = found.to_pylist()
        if len(self.ids) + len(found) >= 1 << ID_BITS:  # a chunk holds fewer words than there are ids
            yield from self.spill()
        ids, langs = self.ids, self.languages
        known = np.array([ids.setdefault(w, len(ids) + 1) for w in found] + [0], np.int64)
        language = np.array([langs.setdefault(x, len(langs)) for x in names], np.int64)
        w, go_on = known[local], joined[reach]
        rest = np.zeros(len(w), np.int64)
        alive = np.ones(len(w), bool)
        for k in range(1, self.sizes[-1]):
            if len(w) > k:
                alive[:-k] &= go_on[k - 1:-1]
                rest[:-k] |= np.where(alive[:-k], w[k:], 0) << (LONGEST - 1 - k) * ID_BITS
        first = (language[code[reach]] << ID_BITS) | w
        enough = rest if self.sizes[0] < 2 else rest >> (LONGEST - self.sizes[0]) * ID_BITS & (1 << ID_BITS) - 1
        at = np.arange(end - begin) if self.sizes[0] < 2 else np.flatnonzero(enough[: end - begin])
        first, rest = first[at], rest[at]
        if not len(at):
            return
        self.trie.add(*distinct(first, rest))
        if self.trie.size >= HELD:
            yield from self.spill()

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All subtrees as sorted runs, one per bucket and phrase length."""
        first, rest, count = self.trie.spill()
        names, words = pa.array(list(self.languages), pa.large_string()), pa.array(list(self.ids), pa.large_string())
        self.start()
        if not len(first):
            return
        # words in byte order take less room in a run
        in_order = pc.sort_indices(words)
        words = words.take(in_order)
        place = np.zeros(len(words) + 1, np.int64)
        place[in_order.to_numpy().astype(np.int64) + 1] = np.arange(1, len(words) + 1)
        mask = (1 << ID_BITS) - 1
        columns = [place[x & mask] for x in (first, rest >> 2 * ID_BITS, rest >> ID_BITS, rest)]
        key = columns[0] << ID_BITS | columns[1]
        order = np.argsort((first >> ID_BITS) << 2 * ID_BITS | key) if self.sizes[-1] <= 2 and len(names) < 1 << 22 else np.lexsort(
            (columns[3], columns[2], key, first >> ID_BITS))
        columns, count = [(first >> ID_BITS)[order], *(c[order] for c in columns)], count[order]
        h = np.concatenate(([0], word_hash(words))).astype(np.uint64)
        of_language = word_hash(names)
        differs = np.zeros(len(count), bool)
        differs[0] = True
        out: list[tuple] = []
        for size in range(LONGEST + 1):
            differs[1:] |= columns[size][1:] != columns[size][:-1]
            if size not in self.sizes:
                continue
            at = np.flatnonzero(differs)
            total = np.add.reduceat(count, at)
            whole = columns[size][at] > 0
            at, total = at[whole], total[whole]
            phrase = [c[at] for c in columns[: size + 1]]
            bucket = phrase_hash(of_language[phrase[0]], [h[c] for c in phrase[1:]]) % np.uint64(self.buckets)
            bucket = bucket.astype(np.uint16 if self.buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.append(0, np.cumsum(np.bincount(bucket, minlength=self.buckets)))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                rows = order[edges[b]:edges[b + 1]]
                used, local = np.unique(np.concatenate([c[rows] for c in phrase[1:]]), return_inverse=True)
                out.append((b, size, pack(names, words.take(pa.array(used - 1)), [phrase[0][rows], *np.split(local, size), total[rows]])))
        yield pa.record_batch([
            pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()),
        ], names=["bucket", "size", "run"])


def runs(
    docs: DataFrame, sizes: tuple[int, ...], buckets: int, words: BlockedFilter | None = None, pairs: BlockedFilter | None = None
) -> DataFrame:
    """Sorted runs of the phrases of docs(text, lang) with so many words: bucket, size, run."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast([x and x.bits for x in (words, pairs)])  # 2 * FILTER_BLOCKS * 32 bytes at most

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sizes, buckets, *(None if bits is None else BlockedFilter(bits) for bits in sent.value))
        for batch in stream:
            for begin, part in slices(batch.column("text")):
                yield from counter.add(part, batch.column("lang").slice(begin, len(part)).to_pylist())
        yield from counter.spill()

    return rows.mapInArrow(count, RUN)


def merge_runs(least: int):
    """All runs of a bucket and phrase length -> lang, phrase, size, n of the phrases with n >= least.

    Words also add up to the bucket's share of all words of a language, size 0.
    """

    def merge(group: pa.Table) -> pa.Table:
        size = group["size"][0].as_py()
        texts, columns = [], []
        begin = 0
        for run in group["run"]:
            languages, words, held = unpack(run.as_py())
            texts.append(pa.concat_arrays([languages, words]))
            columns.append([held[0] + begin, *(c + (begin + len(languages)) for c in held[1:-1]), held[-1]])
            begin += len(texts[-1])
        coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary
        words = [code[np.concatenate([c[i] for c in columns])] for i in range(size + 1)]
        count = np.concatenate([c[-1] for c in columns])
        order = np.lexsort(words[::-1])
        words, count = [w[order] for w in words], count[order]
        differs = np.zeros(len(count), bool)
        differs[0] = True
        for w in words:
            differs[1:] |= w[1:] != w[:-1]
        at = np.flatnonzero(differs)
        total = np.add.reduceat(count, at)
        at, total = at[total >= least], total[total >= least]
        lang, n, sizes = names.take(pa.array(words[0][at])), total, np.full(len(at), size)
        phrase = pc.binary_join_element_wise(*(names.take(pa.array(w[at])) for w in words[1:]), pa.scalar(" ", names.type))
        if size == 1:
            of_language = np.bincount(words[0], weights=count).astype(np.int64)  # exact below 2**53 words a bucket
            seen = np.flatnonzero(of_language)
            lang = pa.concat_arrays([lang, names.take(pa.array(seen))])
            phrase = pa.concat_arrays([phrase, pa.nulls(len(seen), phrase.type)])
            n, sizes = np.append(n, of_language[seen]), np.append(sizes, np.zeros(len(seen), np.int64))
        return pa.table({"lang": lang.cast(pa.string()), "phrase": phrase.cast(pa.string()), "size": pa.array(sizes.astype(np.int32)),
                         "n": pa.array(n.astype(np.int64))})

    return merge


def filter_of(table: DataFrame) -> BlockedFilter:
    """Filter of the phrases of a table(lang, phrase)."""

    def hashes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            split = pc.split_pattern(batch.column("phrase"), " ")
            h, size = word_hash(split.flatten()), pc.list_value_length(split).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            words = [h[begin + i] for i in range(int(size[0]))] if len(size) else []
            yield pa.record_batch([pa.array(phrase_hash(word_hash(batch.column("lang")), words).view(np.int64))], names=["h"])

    return build_filter(table.select("lang", "phrase").mapInArrow(hashes, "h long"), FILTER_BLOCKS)


def counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size, n of all phrases of one to four words with n >= least; size 0 is the language itself, always there."""
    buckets = shuffle_partitions(docs.sparkSession)

    def frequent(sizes: tuple[int, ...], *known: BlockedFilter) -> DataFrame:
        held = runs(docs, sizes, buckets, *known)
        return stage(held.groupBy("bucket", "size").applyInArrow(merge_runs(least), COUNTED), "phrase-counts")

    alone = frequent((1,))
    words = filter_of(alone.filter("size = 1"))
    pairs = frequent((2,), words)
    longer = frequent((3, 4), words, filter_of(pairs))
    languages = alone.filter("size = 0").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return union_all(alone.filter("size = 1"), pairs, longer, languages)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80) -> DataFrame:
    """Per language the `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    a, l, r: counts of the phrase and of the two parts of its lowest-scoring cut; score: floor(2000000 a / (l + r)). A phrase
    inside a longer candidate with at least inside_percent of its count is dropped.
    """
    table = counts(docs, least)
    alone = table.select("lang", "phrase", "n")
    phrases = table.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.selectExpr("*", "explode(sequence(1, size - 1)) AS k").selectExpr(
        "*", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - size) AS rest")
    scored = (
        cuts.join(alone.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(alone.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .withColumn("score", F.expr("(cast(2000000 AS decimal(18, 0)) * cast(a AS decimal(19, 0))) "
                                    "div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))"))
        .groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    part = "concat_ws(' ', slice(split(phrase, ' '), i, m))"
    inside = phrases.filter("size > 2").selectExpr("*", "explode(sequence(2, size - 1)) AS m").selectExpr(
        "*", "explode(sequence(1, size - m + 1)) AS i").selectExpr("lang", f"{part} AS phrase", "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(
        "longer IS NULL OR cast(100 AS decimal(18, 0)) * cast(longer AS decimal(19, 0)) "
        f"< cast({int(inside_percent)} AS decimal(18, 0)) * cast(a AS decimal(19, 0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_n_per_key(kept.drop("longer"), ["lang"], order, top)
    size = table.filter("size = 0").select("lang", "n")
    return best.join(size, "lang").selectExpr(
        "lang", "cast(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS bigint) AS rank",
        "phrase", "a", "l", "r", "n", "score")
