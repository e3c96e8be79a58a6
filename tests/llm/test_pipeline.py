"""The pipeline against a version without Spark."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from .test_near_copies import near, sets
from .test_operators import base, classes, sha

from sparkbits.llm import language_id

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "sentencepiece"]


def test_run(spark, docs, rows, tmp_path):
    import sentencepiece

    from sparkbits.llm.queries import tokenizer_file

    leak = " ".join(next(t for i, t, *_ in rows if i == 55).split()[200:230])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    close = {r.row.doc_id for r in language_id.identify(docs, carry=True, flag_below=corpus_pipeline.CLOSE).where("ambiguous").collect()}
    assert len(close) < len(kept) / 10
    kept = [r for r in kept if r[0] not in close]
    group = classes(sets(r[1] for r in kept), near)
    first = {}
    for r, g in sorted(zip(kept, group), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(g, r)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    want = Counter()
    for i, t, *_ in first.values():
        t = t.replace(leak, "")
        spans = [(a, e) for a, _, e, _ in base(t)]
        if i == 61:
            spans = [m.span() for m in re.finditer(r"AKIA12345678|secret: abcd12345|https://store.example.com/a|AKIA(?:Z9)+", t)]
        out, at = "", 0
        for a, e in sorted(spans):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, e)
        ids = sp.encode(out + t[at:])
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_stage_schemas(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
