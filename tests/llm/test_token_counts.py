import random

import pytest
from hypothesis import given, settings, strategies as st
from macropanel.llm import token_counts
from tokenizers import Tokenizer, models, pre_tokenizers

PUBLIC = token_counts.public_pieces()
#: Many ties; not all characters known; no byte pieces.
SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁a", -3.0), ("▁ab", -4.0), ("bb", -1.5), ("cc", -2.0)]


def library(vocabulary, byte_fallback):
    made = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


LIBRARY = {"public": library(PUBLIC, True), "small": library(SMALL, False)}
OWN = {"public": token_counts.Unigram(PUBLIC), "small": token_counts.Unigram(SMALL)}


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["public", "small"]), st.text(st.one_of(st.sampled_from(" ab cd▁\n"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_counts_are_the_library_s(which, text):
    assert OWN[which].text(text)[0] == len(LIBRARY[which].encode(text, add_special_tokens=False).ids)


def test_words_and_marks():
    rng = random.Random(1)
    for text in ("", " ", "  two  spaces ", "▁mark ▁", "<s> </s> <0x41> <unk>", "héllo wörld 😀😀 日本語", "x" * 3000, "\n\t a", " ".join("".join(rng.choices("theandionr", k=rng.randint(1, 12))) for _ in range(500))):
        assert OWN["public"].text(text)[0] == len(LIBRARY["public"].encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("word", ["▁ababab", "▁abba", "▁cca", "▁zabz"])
def test_score_is_the_best_of_all_segmentations(word):
    scores = dict(SMALL)
    low = min(scores.values()) - token_counts.UNKNOWN_PENALTY

    def best(rest):
        if not rest:
            return 0.0
        ways = [scores[rest[:k]] + best(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in scores]
        return max(ways + ([] if rest[0] in scores else [low + best(rest[1:])]))

    assert OWN["small"].search(word)[1] == best(word)


def test_rows(odd_docs, no_docs):
    got = token_counts.count_tokens(odd_docs, PUBLIC).collect()
    want = sorted((str(r.doc_id), len(LIBRARY["public"].encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(no_docs, PUBLIC).count() == 0
