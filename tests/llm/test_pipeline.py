import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidepool.llm import toxicity
from tidepool.llm.common import written
from tidepool.llm.pii import base_spans
from tidepool.llm.simhash import fingerprint
from tidepool.llm.toxicity import held_out

from .test_simhash import brute as brute_groups
from .test_simhash import corpus as near_copies
from .test_toxicity import corpus as toxic_corpus

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_near_dedup_keeps_the_smallest_id_of_each_group(spark):
    rows = [(d, t, "en", 5) for d, t in near_copies() if d != 3] + [(3, near_copies()[3][1], "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    want = {g for _, _, g in brute_groups([(d, t) for d, t, *_ in rows])}
    got = cp.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_near_dedup_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "other words stand here now"), (1, "a b c d e"), (None, "a b c d e"), (None, "no id at all for this"), (None, "no id at all for this"), (2, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in cp.drop_near_duplicates(spark, docs, "").collect()))) == sorted(map(str, [rows[0], rows[1], rows[4]]))


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    docs, labels = toxic_corpus(spark)
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id", "concat(text, if(doc_id % 50 = 1, ' mail a.b@mail.example.com', '')) as text", "'en' as lang", "'s' as source", "length(text) as n_chars", "score")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, state = docs.columns, docs
    kept = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, labels, ~held_out())
    for name, stage in cp.STAGES[:-1]:
        state = written(stage(spark, state, str(tmp_path)), name)
        rows = {r.doc_id: r for r in state.collect()}
        assert state.columns == columns and len(rows) == state.count()
        if name == "toxicity":
            words = model.words()
            kept = {d: t for d, t in kept.items() if model.score(t or "", words) < 0.5}
        elif name == "near_dedup":
            stay = {g for _, _, g in brute_groups(list(kept.items()))}
            kept = {d: t for d, t in kept.items() if d in stay}
        else:
            assert all(not base_spans(r.text or "") for r in rows.values())
            assert any("[EMAIL]" in (r.text or "") for r in rows.values())
            kept = {d: t and re.sub(r"a\.b@mail\.example\.com", "[EMAIL]", t) for d, t in kept.items()}
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)
        assert {d: r.text for d, r in rows.items()} == kept
    lengths = {d: len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in kept.items()}
    out = cp.run(spark, str(tmp_path)).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == lengths
    assert fingerprint("") == 0
