"""The pipeline against brute force, stage by stage, each on its own input."""

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece as library
from tests.llm import test_decontaminate, test_near_dups

from tidelog.llm import secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(stage, rows before, rows after) of a run with every stage's result written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        assert name == "sentencepiece" or docs.dtypes == columns
        out[name] = before, docs
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = rows(before)
    scores = toxicity.scores([t or "" for _, t in texts], model)
    assert rows(after) == [r for r, s in zip(texts, scores) if s < 0.5]


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    texts = rows(before)
    named = test_near_dups.by_hand(texts, 5, 80)
    kept = {i for i, _, c in named if i == c}
    assert rows(after) == [r for r in texts if r[0] in kept]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in test_decontaminate.by_hand(rows(before), items) if r[5]}
    assert rows(after) == [r for r in rows(before) if r[0] not in dirty]


def test_secrets(stages):
    before, after = (rows(df) for df in stages["secrets"])
    assert [i for i, _ in before] == [i for i, _ in after]
    for (_, old), (_, new) in zip(before, after):
        base = secrets.base_spans(old or "")
        if base:
            assert new != old and not secrets.base_spans(new)
            assert new == secrets.redact(old, [(a, b) for a, _, b in base]) or "[secret]" in new
        elif new != old:
            assert "[secret]" in new


def test_sentencepiece(stages):
    before, after = stages["sentencepiece"]
    processor = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"], list(r["pieces"])) for r in after.collect()) == [(i, processor.encode(t or "")) for i, t in rows(before)]


def test_run_is_its_stages(spark, stages):
    got = sorted((r["doc_id"], list(r["pieces"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], list(r["pieces"])) for r in stages["sentencepiece"][1].collect())
