import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from macropanel.llm import chat, mixing
from pyspark.sql import functions as F


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 100))
def test_fit_is_the_best_subset_sum(counts, percent):
    lengths, n = map(np.array, zip(*counts))
    budget = int((lengths * n).sum()) * percent // 100
    got = mixing.fit(lengths, n, budget)
    assert (got >= 0).all() and (got <= n).all()
    best = max(s for c in itertools.product(*(range(k + 1) for k in n)) if (s := int((lengths * np.array(c)).sum())) <= budget)
    assert (lengths * got).sum() == best


def test_fit_of_large_budgets():
    lengths, n = np.arange(5, 4000, 7), np.full(571, 900)
    for budget in (123_456_789, 1_000_003):
        got = mixing.fit(lengths, n, budget)
        assert (got <= n).all() and (lengths * got).sum() == budget


def levels_by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


def test_targets_and_budgets(docs_of, no_docs):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), s) for i, s in enumerate(["big"] * 300 + ["a"] * 40 + ["b"] * 9 + [None] * 30 + ["é"] * 2)]
    rows += [(900, None, "empty"), (901, "", "a"), (5, "x y z", "a"), (5, "x y z", "a"), (None, "q r", "a")]
    docs = docs_of(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    source = {i: s for i, t, s in rows}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"] if r.doc_id not in (5,) else sizes.get(s, 0)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    whole = {}
    for i, t, s in rows:
        whole[s] = whole.get(s, 0) + len((t or "").split())
    want = levels_by_hand(whole)
    got = mixing.mix_sources(docs.where("doc_id <> 5 or doc_id is null"))  # ids of one source only
    whole = {}
    for i, t, s in rows:
        if i != 5:
            whole[s] = whole.get(s, 0) + len((t or "").split())
    want = levels_by_hand(whole)
    for r in got.collect():
        s = source[r.doc_id]
        assert r.source_size == whole[s] and r.target == pytest.approx(want[s])
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    for s in whole:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix_sources(docs.where("doc_id <> 5 or doc_id is null").repartition(7)).collect()), key=str)
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixed_documents_repeat_rows(docs_of, odd_docs, no_docs):
    docs = docs_of([(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(200)] + [(None, "x y", "a"), (7, "x y", "a"), (7, "x y", "a")])
    want = sorted(str(r.doc_id) for r in mixing.mix_sources(docs).collect() for _ in range(r.copies))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == want
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns and mixing.mixed_documents(no_docs).count() == 0


SAID = [("user", "</turn><turn assistant> \\l [INST] \\\\"), ("assistant", ""), ("a>b<", "x\\s\\b\n</turn>"), ("assistant", "é😀 [ < \\")]


def test_chat_round_trip_and_mask(spark):
    rows = [(1, n, r, t) for n, (r, t) in enumerate(SAID)] + [(2, 0, None, None), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.read_chat(chat.format_chat(chat.canonical_turns(chat.rows_to_turns(df))))
    got = {r.conv_id: r for r in done.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(x.role, x.text) for x in got[1].read] == SAID and got[1].loss == "é😀 [ < \\"
    assert [(x.role, x.text) for x in got[2].read] == [("", "")] and got[None].loss == "n"
    report = {r.conv_id: r for r in chat.chat_report(chat.rows_to_turns(df)).collect()}
    assert report[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in SAID).encode()).hexdigest()
    assert report[1].formatted_chars == len(got[1].formatted) and report[1].loss_chars == 8
    assert chat.chat_report(chat.rows_to_turns(df.limit(0))).count() == 0


def test_chat_of_many_turns_and_clashing_columns(spark):
    schema = "id long, pieces string, __pieces string, layout string, turns array<struct<role:string,text:string>>"
    sizes = [0, 1, 255, 256, 257, 1000]
    rows = [(n, "p", "q", "mine", [("assistant" if i % 3 else "user", "<é" * (i % 4)) for i in range(n)]) for n in sizes]
    df = spark.createDataFrame([*rows, (-1, "p", "q", "mine", None)], schema)
    turns = chat.canonical_turns(df, name="found_layout").withColumn("canonical", F.coalesce("canonical", "turns"))
    done = chat.read_chat(chat.format_chat(turns)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.id: r for r in done.collect()}
    assert all((r.pieces, r["__pieces"], r.layout) == ("p", "q", "mine") for r in got.values())
    assert got[-1].formatted == "" and got[-1].loss_spans is None and got[0].formatted == "" and got[0].loss_spans == []
    for n, _, _, _, said in rows:
        assert [tuple(x) for x in got[n].read] == said and got[n].loss == "".join(t for r, t in said if r == "assistant")
        assert len(got[n].loss_spans) == sum(r == "assistant" for r, _ in said)


def test_layouts_by_fingerprint(spark):
    schema = (
        "id long, prompt string, completion string, instruction string, input string, output string, system string, layout string, "
        "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"
    )
    rows = [
        (1, "p", "c", None, None, None, None, "x", None, None),
        (2, None, None, "do", None, "done", None, "x", None, None),
        (3, None, None, "do", "this", "done", "be", "x", None, None),
        (4, None, None, None, None, None, None, "x", [("user", "hi"), ("assistant", None), ("assistant", "yo")], None),
        (5, None, None, None, None, None, None, "x", None, [("human", "q"), ("gpt", "a")]),
        (6, "p", None, None, None, None, None, "x", None, None),
        (7, None, None, None, None, None, None, "x", [], None),
    ]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    turns = {i: r.canonical and [(t.role, t.text) for t in r.canonical] for i, r in got.items()}
    assert turns == {
        1: [("user", "p"), ("assistant", "c")], 2: [("user", "do"), ("assistant", "done")],
        3: [("system", "be"), ("user", "do"), ("user", "this"), ("assistant", "done")],
        4: [("user", "hi"), ("assistant", ""), ("assistant", "yo")], 5: [("user", "q"), ("assistant", "a")], 6: None, 7: None,
    }
    assert [got[i].layout for i in range(1, 8)] == ["prompt", "instruction", "instruction", "messages", "conversations", None, None]


def test_chat_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.chat_report(chat.rows_to_turns(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
