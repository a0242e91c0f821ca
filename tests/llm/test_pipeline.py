"""The pipeline: columns between stages, what each stage decides, and the read shards."""

import numpy as np

import corpus_pipeline as C
from tests.conftest import SF0001


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, SF0001), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    good = [i in kept["quality"] for i, q in labels.items() if q == 1]
    bad = [i in kept["quality"] for i, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and (not bad or sum(bad) / len(bad) < 0.2)
    assert kept["near_duplicates"] < kept["quality"] and len(kept["mix"]) == len(kept["decontaminate"]) <= len(kept["near_duplicates"])
    out = C.STAGES[-1][1](spark, docs, SF0001).collect()
    assert {r.doc_id for r in out} == kept["mix"] and len(out) < before
    out.sort(key=lambda r: r.start)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    # the shards keep the mixed order of the stored rows
    from barspark.llm.tokens import stored_order
    assert [r.doc_id for r in out] == [r.doc_id for r in docs.orderBy(*stored_order(docs)).select("doc_id").collect()]


def test_run_and_registration(spark):
    import __spark_entry__ as entry
    assert {k.split("_")[0] for k in entry.queries() if k.startswith("op")} >= {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    empty = spark.read.parquet(f"{SF0001}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, SF0001)
    assert empty.collect() == []
