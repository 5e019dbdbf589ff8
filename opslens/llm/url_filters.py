"""URL verdicts by listed hosts and path beginnings.

A rule (host, path, verdict) fits a url of its host or a subdomain of it whose path starts with the rule's path; the
longest fitting rule decides (of equally long ones the one with the longer host; of a rule listed with both
verdicts 'block'). A url that no rule fits is not listed and gets `otherwise`, 'allow' unless told.

The list may be long. Its canonical texts (host + path) set bits of a blocked Bloom filter: a key's hash names a block
of 256 bits and one bit in each of its eight words. A url's candidates are the texts a fitting rule could have:
its host and parent domains, each with a beginning of its path, in those (labels, path length) shapes that the list has.
Candidates that the filter cannot exclude go to an exact hash join with the list, which removes false positives.
The filter has BLOCKS blocks at most (8 MB): a longer list makes it let more through, never fewer, so results do
not depend on its size.

Defined results: a null url, or one without '://', has an empty host and path and is not listed. Rows of any number of
columns may repeat, ids may be null; each row gets its verdict. An empty list lets everything through as not listed.
Null hosts or paths of a rule are empty; a rule with an empty host fits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.llm.bloom import BlockedFilter, build_filter
from opslens.llm.common import ascii_lower, whole

BLOCKS = 1 << 18


def canonical(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) with host (A-Z lower-cased) and path, without query and fragment."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("_rest", whole(rest))
    return rows.withColumn("host", ascii_lower(F.regexp_extract("_rest", "^[^/?#]*", 0))).withColumn(
        "path", F.regexp_extract(F.expr("substring(_rest, char_length(host) + 1)"), "^[^?#]*", 0)).drop("_rest")


def listed(rules: DataFrame) -> DataFrame:
    """One row per canonical text: key, rule_host, rule_path, rule_verdict."""
    return rules.select(
        ascii_lower(whole(F.col("host").cast("string"))).alias("rule_host"), whole(F.col("path").cast("string")).alias("rule_path"),
        "verdict",
    ).filter("rule_host <> ''").groupBy("rule_host", "rule_path").agg(
        F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("rule_verdict")
    ).withColumn("key", F.concat("rule_host", "rule_path"))


def possible_hits(urls: DataFrame, shapes: list[tuple[int, int]], known: BlockedFilter) -> DataFrame:
    """urls with `hits`, the candidate texts that the filter cannot exclude."""
    sent = urls.sparkSession.sparkContext.broadcast(known.bits)  # BLOCKS * 32 bytes at most
    listed_shapes = ", ".join(f"struct({labels} AS labels, {length} AS length)" for labels, length in shapes)
    fits = "filter(array({}), s -> s.labels <= size(labels) AND s.length <= char_length(path))".format(listed_shapes)
    text = "concat(array_join(slice(labels, size(labels) - s.labels + 1, s.labels), '.'), left(path, s.length))"
    keyed = urls.withColumn("labels", F.split("host", r"\.")).withColumn(
        "keys", F.expr(f"if(host = '', cast(array() AS array<string>), transform({fits}, s -> {text}))")
    ).withColumn("hashes", F.expr("transform(keys, k -> xxhash64(k))")).drop("labels")
    plain = [f.name for f in urls.schema]

    def probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = BlockedFilter(sent.value)
        for batch in stream:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            maybe = test.may_hold(hashes.flatten().to_numpy().view(np.uint64))
            sizes = np.diff(hashes.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)[maybe]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes))))).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(offsets), keys.flatten().filter(pa.array(maybe)))
            yield pa.record_batch([batch.column(c) for c in plain] + [hits], names=[*plain, "hits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return keyed.mapInArrow(probe, f"{fields}, hits array<string>")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url); rules(host, path, verdict)."""
    known = listed(rules)
    urls = canonical(pages).select("page_id", "host", "path")
    # at most one shape per number of labels and path length that a listed text has
    shapes = [(r.labels, r.length) for r in known.select(
        F.size(F.split("rule_host", r"\.")).alias("labels"), F.char_length("rule_path").alias("length")).distinct().collect()]
    if not shapes:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    passed = possible_hits(urls, shapes, build_filter(known.select(F.xxhash64("key").alias("h")), BLOCKS))
    # a verdict depends on host and path only: what the filter passed is looked up once per canonical url
    asked = passed.filter("size(hits) > 0").select("host", "path", "hits").distinct()
    best = F.expr("struct(char_length(key) AS size, char_length(rule_host) AS host_size, key AS rule, rule_verdict)")
    found = asked.select("host", "path", F.explode("hits").alias("key")).join(known, "key").groupBy("host", "path").agg(
        F.max(best).alias("best")).select("host", "path", "best.rule", F.col("best.rule_verdict").alias("verdict"))
    none = passed.filter("size(hits) = 0").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    hit = passed.filter("size(hits) > 0").select("page_id", "host", "path").join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
    return union_all(none, hit)


def digest(pages: DataFrame) -> DataFrame:
    """Verdicts by the five rules of the contract."""
    # fixed values: (host, path, verdict)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
    return judge(pages, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"))
