"""Line dedup, near duplicates, fingerprints and BPE against plain Python."""

import collections
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.llm import bpe, fingerprints, lines, neardup, text

DOCS = "doc_id long, text string"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """Extra columns whose names operators use."""
    names = ["lines", "key", "node", "id", "sig", "size", "rep", "component", "slice", "extra", "n_lines", "score", "kept", "_n"]
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBß \t\n\x0b\x0c\r\x1c  ", max_size=12)), max_size=8))
def test_words_are_found_and_hashed_alike(texts):
    data, offsets = text.utf8(pa.array(texts, pa.string()))
    hashes, firsts = text.word_hashes(data, offsets)
    want = [brute.words(t) for t in texts]
    assert np.diff(firsts).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    same = {w: h for w, h in zip(flat, hashes.tolist())}
    assert [same[w] for w in flat] == hashes.tolist()
    assert len(set(same.values())) == len(same)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    shared = [f"{'shared line of text ' * 2}{i:04d}" for i in range(6)] + ["short"]
    rows = []
    for i in range(40):
        own = [rng.choice(shared).upper() if rng.random() < 0.3 else "  " + rng.choice(shared) + "\t" for _ in range(rng.randint(0, 5))]
        rows.append((i if i % 9 else None, "\n".join([*own, f"own {i} " * 9])))
    rows += [(100 + i, t) for i, t in enumerate(brute.EDGES)] + [rows[3], rows[3], (3, "other text"), (1, shared[0] + "\n" + shared[0])]
    got = lines.dedup_lines(clashing(table(spark, rows))).collect()
    key = repr
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute.line_dedup(rows), key=key)
    assert lines.dedup_lines(table(spark, [])).collect() == []


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaf, levels", [(512, 4), (8, 2)])
def test_near_duplicates_match_all_pairs(spark, leaf, levels):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts = [*brute.EDGES, "a b c", "A b C", "c b a"]
    for _ in range(6):
        texts += [(b := prose(150)), b, b.upper(), *family(rng, b, 5, 2)]
    chain = [prose(160)]
    for _ in range(7):  # each is near the one before it only
        chain += family(rng, chain[-1], 1, 4)
    texts += chain + [(hub := prose(200)), *family(rng, hub, 30, 4), *[prose(40) for _ in range(30)]]
    rng.shuffle(texts)
    rows = [(i * 7 + 5, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(clashing(table(spark, rows)), words=4, leaf=leaf, levels=levels).collect()
    want = brute.near_dup(rows, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("levels", [0, 1])
def test_near_duplicates_inside_a_template_family(spark, levels):
    """All share a template at a similarity of 0.75; 15 pairs share half of the rest too (0.87)."""
    words = iter(range(10**6))
    fresh = lambda n: [f"t{next(words)}" for _ in range(n)]
    template = fresh(123)
    texts = []
    for i in range(120):
        own = fresh(20)
        texts.append(template + own)
        if i % 8 == 0:
            texts.append(template + own[:10] + fresh(10))
    random.Random(4).shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(table(spark, rows), words=4, leaf=16, levels=levels).collect()
    want = brute.near_dup(rows, 4)
    assert len({c for _, c in want.values()}) == 120
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, None), (1, "a b c d e")]
    got = neardup.near_duplicates(table(spark, rows), words=4).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(None, 2, None, True)] * 2 + [(3, 2, 1, False)] * 2 + [(2, 0, 2, True), (1, 2, 1, True)], key=repr
    )
    assert neardup.near_duplicates(table(spark, []), words=4).collect() == []


def test_components_of_a_long_chain(spark):
    links = table(spark, [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 80)))) for i in range(50)]
    rows += [(1000 + i, t) for i, t in enumerate(brute.EDGES)] + [(None, "last one"), (5, "é" * 7)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(clashing(table(spark, rows))).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, (doc, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[doc]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - brute.generalised_jaccard(t, edited), r["near_next"] - brute.generalised_jaccard(t, after)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and abs(np.mean(errors)) < 0.02
    prints = fingerprints.fingerprint(table(spark, [(1, "b a"), (2, "A  b"), (3, None), (4, " ")])).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in prints}
    assert by[1] == by[2] and by[3] == by[4] and by[1] != by[3]


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.compare_with_next(table(spark, [])).collect() == []
    (one,) = fingerprints.compare_with_next(table(spark, [(7, "abcd")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    same = fingerprints.compare_with_next(table(spark, [(7, "a b"), (7, "a b"), (7, "c")])).collect()
    assert len(same) == 3


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'srtvemdl S12 \n\t.! \x1cé日"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_bpe_equals_the_library(codec, library, texts):
    flat, firsts = codec.encode(texts)
    for t, a, b in zip(texts, firsts[:-1], firsts[1:]):
        ids = flat[a:b].tolist()
        assert ids == library.encode_ordinary(t)
        assert codec.decode(flat[a:b]).decode() == t
        assert codec.offsets(flat[a:b])[-1] == len(t.encode())


def test_long_pieces_merge_alike(codec, library):
    rng = random.Random(1)
    for piece in ("a" * 4000, "".join(rng.choice("abc") for _ in range(3000)), "!?" * 900, " " * 5000, "'ll" * 99):
        assert codec.encode([piece])[0].tolist() == library.encode_ordinary(piece)


def test_bpe_tables(spark, ranks, library):
    rows = [(i, t) for i, t in enumerate(brute.EDGES)] + [(None, "null id"), (3, "again"), (3, "again")]
    coded = bpe.encode(clashing(table(spark, rows)), ranks, ("n_tokens", "ids", "byte_offsets", "ids_sha256", "decoded_sha256"))
    want = collections.Counter((d, tuple(library.encode_ordinary(t or ""))) for d, t in rows)
    got = coded.collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) == len(r["byte_offsets"]) - 1 for r in got)
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in got)
    back = bpe.decode(coded, ranks).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((d, t or "") for d, t in rows)
    assert {r["decoded_sha256"] for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bpe.encode(table(spark, []), ranks).collect() == []
