import public_tokenizers
import sentencepiece

import corpus_pipeline
from palisade.llm import mixing, quality, secrets
from palisade.session import settle
from tests.llm.helpers import ODD, WORD, documents
from tests.llm.test_secrets import brute as base_spans
from tests.llm.test_simhash import brute as groups_of


def test_every_stage_on_its_own_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = settle(stage(spark, docs, small), "test-stage")
        before, after = docs.collect(), made.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns and made.dtypes == docs.dtypes
        if name == "quality rules":
            want = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
            assert {r.doc_id for r in after} == want and len(after) == len(want)
        elif name == "SimHash near-dedup":
            found = groups_of([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in found if i == c)
        elif name == "secret scans":
            assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
            assert all(base_spans(r.text)[4] == "" for r in after)
            same = {r.doc_id: r.text for r in before if secrets.REDACTED not in r.text}
            assert sum(r.text == same.get(r.doc_id) for r in after) >= len(same) * 0.8
        elif name == "mixing sources":
            plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
            words = {}
            for r in after:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
            assert words == plan
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert sorted((r.doc_id, len(library.encode(r.text))) for r in before) == sorted((r.doc_id, r.n_tokens) for r in after)
        kept[name] = len(after)
        docs = made
    assert corpus_pipeline.run(spark, small).count() == kept["SentencePiece"]


def test_odd_rows(spark):
    for rows in (ODD, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, ""), "test-stage")
        docs.collect()
