import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from macropanel.llm import exact_dedup, ngram_join
from macropanel.llm.common import table

SF = entry.SMALLEST


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.collect()} for n, d in seen.items()}
    kept = {r.doc_id for r in exact_dedup.exact_duplicates(seen["toxicity"]).where("kept").collect()}
    assert ids["exact_dedup"] == kept
    near = {r.doc_id for r in ngram_join.similar_texts(seen["exact_dedup"]).where("doc_id = component_id").collect()}
    assert ids["near_dedup"] == near and ids["mixing"] <= near
    rows = seen["tokens"].collect()
    assert len(rows) == seen["mixing"].count() and all(len(r.ids) % 4 == 0 for r in rows)
    assert {r.doc_id for r in rows if r.ids} <= {r.doc_id for r in seen["mixing"].collect() if r.text}
    assert sum(len(np.frombuffer(r.ids, "<u4")) for r in rows) > 0


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
