"""Quality rules as a short-circuit cascade.

Every rule rejects a document on a few counts of its text. What a rule costs (its counts are timed) and how much it
rejects is estimated on a bounded random sample, and the rules run in descending order of rejection per cost, both
taken over the documents that the rules before them leave. A document leaves the cascade at the first rule
that rejects it, so later counts are not made for it. The order changes the work only; a document is kept if no
rule rejects it.

Words are runs of characters outside [\\x20\\x09-\\x0D]. A null or blank text has no words and is rejected by
`too_short`. Repeated rows get equal verdicts, ids and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import let, strip, whole, words
from opslens.session import stage

SAMPLE_ROWS = 2000
TIMED_ROWS = 2000
LEAST_COST = 1e-7
INDEX_BITS = 28


def word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    spoken = F.filter(F.split(whole(text), "\n", -1), lambda x: strip(x) != "")
    return let(spoken, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more.

    Windows are compared by 64-bit hash. If all are distinct nothing more is done. Otherwise hashes,
    cut to make room for their position, are sorted as plain numbers; neighbours with equal cut
    hashes are then compared in full. Each repeated window adds the words that the one before it did not cover.
    """
    low = (1 << INDEX_BITS) - 1
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def beside(rows: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(rows, lambda x, i: F.coalesce(same(x, F.get(rows, i - 1)), F.lit(False))
                        | F.coalesce(same(x, F.get(rows, i + 1)), F.lit(False)))

    def positions(h: Column) -> Column:
        cut = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        near = let(cut, lambda s: beside(s, lambda a, b: F.shiftright(a, INDEX_BITS) == F.shiftright(b, INDEX_BITS)))
        at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        full = F.sort_array(F.transform(near, lambda x: F.struct(F.get(h, at(x)).alias("h"), at(x).alias("i"))))
        twice = let(full, lambda s: beside(s, lambda a, b: a["h"] == b["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, x: a + x,
        )

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
               .otherwise(let(positions(h), covered)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(some)


# Counts by name, from the text and its words.
COUNTS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: word_chars(w),
    "n_symbols": lambda text, w: n_symbols(text),
    "n_dup_lines": lambda text, w: n_dup_lines(text),
    "n_repeat_words": lambda text, w: n_repeat_words(w),
    "n_lines": lambda text, w: F.size(F.filter(F.split(whole(text), "\n", -1), lambda x: strip(x) != "")).cast("long"),
    "n_shouts": lambda text, w: F.regexp_count(whole(text), F.lit("!!")).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """rejects: from the counts; uses: the counts."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]


RULES = (
    Rule("too_short", ("n_words",), lambda c: c["n_words"] < 50),
    Rule("repeats_itself", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda c: 10 * c["n_dup_lines"] > 5 * c["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"),
         lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
    Rule("shouting", ("n_words", "n_shouts"), lambda c: 10 * c["n_shouts"] > c["n_words"]),
)
BASE = ("too_short", "repeats_itself")


def counts_of(text: Column, w: Column, names: Sequence[str]) -> dict[str, Column]:
    return {name: COUNTS[name](text, w) for name in names}


def costs(sample: DataFrame, rows: int, names: Sequence[str]) -> dict[str, float]:
    """Seconds a document of each count, timed over a sample(text, _w) of so many rows, repeated up to TIMED_ROWS."""
    times = max(1, -(-TIMED_ROWS // rows))
    many = sample.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def took(value: Column) -> float:
        def once() -> float:
            begin = perf_counter()
            many.agg(F.sum(value)).collect()
            return perf_counter() - begin

        return min(once(), once())

    reading = took(F.size("_w") + F.char_length("text"))
    values = counts_of(F.col("text"), F.col("_w"), names)
    return {name: max(LEAST_COST, (took(value) - reading) / (rows * times)) for name, value in values.items()}


def ranked(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in descending order of rejection per cost, estimated on about sample_rows random rows.

    The sample is written once. What comes back are the time of each count and the rows per set of rejecting rules. Each turn takes the
    rule that rejects the most of what is left per second and drops what it rejects. Rules that reject nothing more
    run last, the cheapest first. An empty table leaves the rules as given. The draw is seeded; ties keep the given order.
    """
    n = docs.count()
    if not n:
        return list(rules)
    drawn = docs.select(whole(F.col("text")).alias("text")).sample(min(1.0, sample_rows / n), seed=42)
    some = stage(drawn.repartition(1).withColumn("_w", words(F.col("text"))), "rule-sample")
    every = sorted({u for r in rules for u in r.uses})
    counted = some.select(*[v.alias(k) for k, v in counts_of(F.col("text"), F.col("_w"), every).items()])
    verdicts = F.array(*[r.rejects({u: F.col(u) for u in r.uses}) for r in rules])
    left = counted.groupBy(verdicts.alias("by")).agg(F.count("*").alias("rows")).collect()
    if not left:
        return list(rules)
    cost = costs(some, sum(g["rows"] for g in left), every)
    order: list[Rule] = []
    while len(order) < len(rules):
        size = sum(g["rows"] for g in left)

        def worth(i: int) -> tuple[float, float]:
            seconds = sum(cost[u] for u in rules[i].uses)
            return sum(g["rows"] for g in left if g["by"][i]) / (max(1, size) * seconds), -seconds

        best = max((i for i, r in enumerate(rules) if r not in order), key=worth)
        order.append(rules[best])
        left = [g for g in left if not g["by"][best]]
    return order


def verdict(rules: Sequence[Rule], counts: Mapping[str, Column]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    chain = None
    for r in rules:
        test = r.rejects(counts)
        chain = F.when(test, r.name) if chain is None else chain.when(test, r.name)
    return chain


def rejected_by(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with rejected_by: the first rule of the cascade that rejects, null for kept ones."""
    order = ranked(docs, rules)
    every = sorted({u for r in rules for u in r.uses})
    text = F.col("text")
    return docs.withColumn("rejected_by", let(words(text), lambda w: verdict(order, counts_of(text, w, every))))


def apply(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects."""
    return rejected_by(docs).filter(F.col("rejected_by").isNull()).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, whether the base rules reject it, and the cascade's verdict."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = [u for u in sorted({u for r in RULES for u in r.uses}) if u not in base]
    held = docs.select("doc_id", "text", words(F.col("text")).alias("_w"))
    text, w = F.col("text"), F.col("_w")
    counted = held.select("doc_id", "text", "_w", *[v.alias(k) for k, v in counts_of(text, w, base).items()])
    # the base counts are asked for; the others are made as far as the cascade comes to them
    cols = {u: F.col(u) for u in base} | counts_of(text, w, more)
    failed = [r.rejects(cols) for r in RULES if r.name in BASE]
    return counted.select(
        "doc_id", *base, (failed[0] | failed[1]).alias("base_failed"),
        verdict(ranked(docs), cols).isNull().alias("kept"),
    )
