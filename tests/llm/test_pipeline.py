"""The pipeline's rows against stages redone by brute force."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from drayage.llm import queries, toxicity
from tests.conftest import DATA
from tests.llm import brute


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judge = toxicity.Judge(queries.toxicity_model(spark, docs, DATA))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [r for r in rows if judge.score(r[1]) < 0.5]
    largest = {}
    for i, t in rows:
        largest[brute.lower(t)] = max(i, largest.get(brute.lower(t), i))
    rows = [r for r in rows if largest[brute.lower(r[1])] == r[0]]
    components = brute.near_components(rows)
    rows = [r for r in rows if components[r[0]][1] == r[0]]
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}

    packed = corpus_pipeline.run(spark, DATA).collect()
    found = {}
    for r in packed:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == want
    filled = {}
    for r in packed:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= queries.PACK_CAPACITY


def test_all_stages_but_the_last_return_documents(spark, odd_documents, no_documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "packing"]
    for start in (odd_documents, no_documents):
        docs = start
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, DATA)
            assert docs.columns == odd_documents.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).columns[0] == "doc_id"
