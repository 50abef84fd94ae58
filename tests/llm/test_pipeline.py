import zlib

import numpy as np

import corpus_pipeline
from pointloom.llm import tokens, toxicity, work

from .test_text_ops import brute_components, brute_hits

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = work.read(spark, DATA, "documents")
    columns, kept = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "repeated_passages", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out, _ = work.store(stage(spark, kept[-1], DATA), f"test-{name}")
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        kept.append(out)
    rows = [sorted((r.doc_id, r.text) for r in k.select("doc_id", "text").collect()) for k in kept[:-1]]
    # toxicity: those that the trained chain scores at 0.5 and more go
    chain = toxicity.train(docs.select("doc_id", "text"), work.read(spark, DATA, "labels"))
    assert rows[1] == [(d, t) for d, t in rows[0] if chain.score(chain.marginals(toxicity.token_words(t or ""))[1]) < 0.5]
    # near-duplicates: the first of each component stays
    assert [d for d, _ in rows[2]] == sorted(d for d, _, c in brute_components(rows[1]) if d == c)
    # repeated passages: what is left is a part of each text, in order, and no 50 words recur in two documents unless kept by the first
    before = dict(rows[2])
    for d, t in rows[3]:
        w, it = t.split(), iter(before[d].split())
        assert all(x in it for x in w)
    seen = {}
    for d, t in rows[3]:
        w = t.lower().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    assert not [k for k, v in seen.items() if len(v) > 1]
    # decontamination
    items = [(r.item_id, r.text) for r in work.read(spark, DATA, "benchmark").collect()]
    hit = {d for d, _, n, _, _ in brute_hits(rows[3], items) if n}
    assert rows[4] == [(d, t) for d, t in rows[3] if d not in hit]
    # packing
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    ids = {d: np.array([*e.ids, 0], "<u4") for (d, _), e in zip(rows[4], t.encode_batch([x for _, x in rows[4]], add_special_tokens=False), strict=True)}
    p = kept[-1].toPandas()
    assert set(p["doc_id"]) == set(ids) and (p.groupby("sequence_id")["length"].sum() <= 2048).all()
    for r in p.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_run_is_the_stages_in_order(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, DATA).where("length > 2048 or length < 1").count() == 0
