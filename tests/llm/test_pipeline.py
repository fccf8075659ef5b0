"""The pipeline against the brute-force versions of its stages."""

import re

import corpus_pipeline
import pytest
from basewise.llm import bpe_words, lang_id
from pyspark.sql import functions as F

from tests.llm.test_near_copies import components
from tests.llm.test_ops import SF, WORD, lower


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "words that stand alone here", None, None, 27), (9_000_001, "", "en", "s", 0), (9_000_002, None, "en", "s", None), (9_000_003, "a kept and plain text of words", "en", "s", 30), (9_000_003, "a kept and plain text of words", "en", "s", 30)]
    return real.union(spark.createDataFrame(odd, real.schema))


def test_stages(spark, docs):
    """Each stage's own input gives what brute force gives; the columns of documents stay until the last."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {tuple(w[k : k + 10]) for r in benchmark for w in [WORD.findall(lower(r.text))] for k in range(max(1, len(w) - 9)) if w}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe_encoding"]
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, SF).cache()
        if name == "language_id":
            want = sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in before)
            assert abs(out.count() - want) <= 2
        if name == "simhash_near_dedup":
            own = dict(sorted((r.doc_id, r.text) for r in before if r.doc_id is not None))
            groups = components(list(own.values()))
            assert sorted(r.doc_id for r in out.filter("doc_id is not null").collect()) == [i for k, i in enumerate(own) if groups[k] == k]
            assert out.filter("doc_id is null").count() == 1
        if name == "benchmark_decontamination":
            sizes = {len(g) for g in windows}
            held = lambda t: any(not windows.isdisjoint(zip(*(w[j:] for j in range(n)), strict=False)) for w in [WORD.findall(lower(t))] for n in sizes)
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before if not held(r.text)} and out.count() < len(before)
        if name == "secret_scans":
            assert out.count() == len(before) and out.filter(F.col("text").rlike(r'token = "[0-9a-f]{40}"|password=[0-9a-f]{18}')).count() == 0 and out.filter("text like '%<SECRET>%'").count() > 0
        if name != "bpe_encoding":
            assert out.columns == docs.columns
            docs = out
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe_words.default_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), own.decode(ids, skip_special_tokens=False))


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 50


def test_empty(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert lang_id.op4_query(docs.limit(0)).count() == 0


def test_no_text_is_lost_where_ids_repeat(spark, docs):
    """Rows that share an id but not a text are judged each by its own text."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(12)) for w in ("alpha", "bravo", "charlie"))
    rows = [(5, a), (7, a), (7, b), (7, b), (8, c), (None, c), (None, "delta " + b), (None, "echo is alone here"), (None, "echo is alone here")]
    own = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    out = corpus_pipeline.near_dedup(spark, own, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(5, a), (7, b), (8, c), (0, "echo is alone here")])
