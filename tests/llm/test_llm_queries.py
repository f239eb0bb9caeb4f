"""The registered queries against their SQL, and the pipeline against plain Python."""

import collections
import hashlib
import os
import sys

import brute
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import DATA, compare, connect  # noqa: E402

from sigloom.llm import bpe, queries  # noqa: E402

SF = DATA.format("0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_near_duplicates_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, SF).collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_chosen_path_dedup(spark, SF).collect()}
    assert got == brute.near_dup(rows, 4)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = queries.documents(spark, SF)
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
    source = {r["doc_id"]: r for r in queries.documents(spark, SF).collect()}
    assert {r["doc_id"] for r in kept["language_id"]} == {d for d, r in source.items() if any(c.isalpha() for c in r["text"] or "")}
    rows = [(r["doc_id"], r["text"]) for r in kept["language_id"]]
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in kept["line_dedup"]} == {
        (d, t, len(t)) for d, t, _, _ in brute.line_dedup(rows)
    }
    rows = [(r["doc_id"], r["text"]) for r in kept["line_dedup"]]
    assert {r["doc_id"] for r in kept["near_dedup"]} == {d for d, (_, c) in brute.near_dup(rows, 5).items() if d == c}
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in kept["near_dedup"]}
    total, taken = collections.Counter(), collections.Counter()
    for r in kept["near_dedup"]:
        total[r["source"]] += size[r["doc_id"]]
    for r in kept["source_mix"]:
        taken[r["source"]] += size[r["doc_id"]]
    largest = max(size.values())
    for s, target in brute.targets(dict(total)).items():
        assert abs(taken[s] - target) <= max(0.02 * target, largest)
    copies = collections.Counter(r["doc_id"] for r in kept["source_mix"])
    assert max(copies.values()) <= 2
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert collections.Counter(r["doc_id"] for r in kept["byte_bpe"]) == copies
    texts = {r["doc_id"]: r["text"] for r in kept["source_mix"]}
    for r in kept["byte_bpe"]:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
