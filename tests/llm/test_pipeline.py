"""The pipeline's stages one after another, each against what its operator's brute force says of its own input."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from opslens.llm.common import table
from tests.llm.test_operators import kept_lines, majority, rule_counts

SF = "/root/testdata/sf0.001"


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    (_, rules), (_, lines), (_, copies), (_, mix), (_, pack) = corpus_pipeline.STAGES

    kept = rules(spark, docs, SF).cache()
    want = set()
    for i, t in plain(docs):
        n, chars, symbols, dup, repeat, n_lines, shouts = rule_counts(t)
        if not (n < 50 or 2 * repeat > n or 10 * symbols > n or 2 * dup > n_lines or chars < 2 * n or chars > 15 * n or 10 * shouts > n):
            want.add(i)
    assert {i for i, _ in plain(kept)} == want and kept.columns == names

    short = lines(spark, kept, SF).cache()


    expected = kept_lines([(i, t) for i, t in plain(kept)])
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in plain(short)} == {i: v[2] for i, v in expected.items()}
    assert short.columns == names

    single = copies(spark, short, SF).cache()
    prints = sorted((i, majority(t)) for i, t in plain(short))
    root = {}
    for i, p in prints:
        near = {root[j] for j, q in prints if j in root and (p ^ q).bit_count() <= 4}
        root[i] = min(near | {i})
        root.update({j: root[i] for j in root if root[j] in near})
    assert sorted(i for i, _ in plain(single)) == sorted(set(root.values())) and single.columns == names

    mixed = mix(spark, single, SF).cache()
    assert mixed.columns == names and mixed.count() > 0
    pieces = pack(spark, mixed, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {i for i, _ in plain(mixed)}
