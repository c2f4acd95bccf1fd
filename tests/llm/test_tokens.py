import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from macropanel.llm import bpe
from macropanel.llm.perfect_hash import PerfectHash

RANKS, PATTERN = bpe.public_vocabulary()
VOCABULARY = bpe.Vocabulary(RANKS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return [x for block in next(VOCABULARY.encode([text])) for x in block.tolist()]


def test_perfect_hash_is_minimal_and_survives_packing():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    made = PerfectHash(keys)
    for h in (made, PerfectHash.from_bytes(made.to_bytes())):
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5
    with pytest.raises(ValueError):
        PerfectHash(keys[[0, 0]])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_are_the_library_s(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1c\x85 ab'sll1.é😀"), max_size=40))
def test_ids_with_odd_white_space(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_pre_tokens_and_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3)
    for text in ("a" * 3000, " " * 2000 + "x", "one two three four five six seven eight", "".join(random.Random(1).choices("abcd", k=2000))):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_report_and_round_trip(spark, odd_docs, no_docs):
    got = sorted(map(tuple, bpe.token_report(odd_docs, RANKS, PATTERN).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        coded = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(coded), hashlib.sha256(np.array(coded, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.token_report(no_docs, RANKS, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd_docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.size == 7 for r in back) and len(back) == odd_docs.count()


def test_a_task_leaves_no_merged_pre_tokens_behind(docs_of, monkeypatch):
    rng = random.Random(3)
    docs = docs_of([(i, " ".join("".join(rng.choices("bcdfgqxz", k=12)) for _ in range(50))) for i in range(8)], 1)
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append((self, run)))
    monkeypatch.setattr(bpe, "_LOADED", {})
    bpe.encode(docs, RANKS, PATTERN)
    source, run = tasks[0]
    ids = [x for batch in run(iter(source.toArrow().to_batches())) for x in batch.column("ids").to_pylist()]
    assert len(ids) == 8 and all(ids)
    assert [(v.merged, v.older) for v in bpe._LOADED.values()] == [({}, {})]


class Counted:
    """A pattern that counts what goes through it."""

    def __init__(self, pattern):
        self.pattern, self.seen = pattern, []

    def findall(self, text):
        self.seen.append(text)
        return self.pattern.findall(text)


def test_chunks_go_through_the_pattern_once_while_remembered():
    own = bpe.Vocabulary(RANKS, PATTERN)
    own.pattern = Counted(own.pattern)
    texts = ["bcdfg qxzvv, wkrtz. bcdfg", "qxzvv, bcdfg", " bcdfg", ""]
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    for _ in range(3):  # pieces of a task's text
        assert [[x for block in blocks for x in block.tolist()] for blocks in own.encode(texts)] == want
    assert len(own.pattern.seen) == len(set(own.pattern.seen))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from(" \nab'l1.é"), max_size=30), max_size=4), max_size=6), st.integers(0, 6))
def test_ids_where_few_chunks_are_remembered(pieces, most):
    VOCABULARY.forget()
    for texts in pieces:
        got = [[x for block in blocks for x in block.tolist()] for blocks in VOCABULARY.encode(texts, most)]
        assert got == [LIBRARY.encode_ordinary(t) for t in texts]
        assert len(VOCABULARY.number) == len(VOCABULARY.uses) == len(VOCABULARY.chunk_length) <= most
        assert len(VOCABULARY.chunk_ids) == VOCABULARY.chunk_length.sum() <= 8 * most


def test_long_chunks_are_not_remembered_beyond_their_share():
    own = bpe.Vocabulary(RANKS, PATTERN)
    rng = random.Random(5)
    for _ in range(6):
        texts = ["short " + "".join(rng.choices("日本語文字", k=400)) for _ in range(10)]
        assert [[x for block in blocks for x in block.tolist()] for blocks in own.encode(texts, 500)] == [LIBRARY.encode_ordinary(t) for t in texts]
        assert len(own.chunk_ids) <= 4000 and " short" in own.number


def test_the_most_used_chunks_stay_and_none_after_a_task_or_a_failure(monkeypatch):
    own = bpe.Vocabulary(RANKS, PATTERN)
    list(own.encode(["often", *[f"often w{i}" for i in range(9)]], 4))
    assert " often" in own.number and len(own.number) == 2
    with monkeypatch.context() as broken:
        broken.setattr(own, "resolve", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            list(own.encode(["new words"]))
    assert [b.tolist() for b in next(own.encode(["new words often"]))] == [LIBRARY.encode_ordinary("new words often")]
    own.forget()
    assert (own.number, own.merged, own.older) == ({}, {}, {}) and not len(own.chunk_ids) and not len(own.uses)
