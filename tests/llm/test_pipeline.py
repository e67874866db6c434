"""The stages together, against brute force on the smallest tables."""

import sentencepiece

import corpus_pipeline as P
from commitlens.llm import quality, secrets
from commitlens.llm import sentencepiece as SP
from llm.conftest import SF
from llm.test_decontaminate import brute
from llm.test_jaccard_join import brute_components, brute_set
from llm.test_secrets import brute_base


def test_pipeline_matches_brute_force(spark, documents):
    docs = {d.doc_id: d for d in documents.collect()}
    verdicts = {r.doc_id: r.quality.kept for r in quality.quality_rules(documents).collect()}
    good = {i for i in docs if verdicts[i]}
    root = brute_components({i: brute_set(docs[i].text, 5) for i in good}, 80)
    single = {i for i in good if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in single if not brute(docs[i].text, items)[4]}
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(got) == clean and clean < single < good < set(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=SP.model_path())
    for i, r in got.items():
        base, out, last = brute_base(docs[i].text), [], 0
        for _, a, b in base:
            if a >= last:
                out += [docs[i].text[last:a], secrets.MARK]
            last = max(last, b)
        assert list(r.tokens) == library.encode("".join([*out, docs[i].text[last:]])) and r.round_trip and r.n_tokens == len(r.tokens)


def test_stages_keep_the_columns(spark, documents):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, documents, SF)
        assert out.columns == documents.columns and out.dtypes == documents.dtypes, name


def test_empty_table(spark, documents):
    for _, stage in P.STAGES:
        assert stage(spark, documents.limit(0), SF).collect() == []
