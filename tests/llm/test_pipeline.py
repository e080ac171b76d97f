"""The pipeline's stages against plain versions of each, on a small corpus."""

import random

import corpus_pipeline
from readloom.llm import bpe, mixing, queries
from tests.llm.test_ops import brute_components, brute_spans, dicts, random_texts


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    texts = [f"mail me at user{i}@mail.example.com about {t}" if i % 9 == 0 else t for i, t in enumerate(random_texts(120, 6))]
    texts += [" ".join(["plain", "quiet", "even"] * 6 + [rng.choice(["vilething", "crueltalk"])] + [f"w{i}{k}" for k in range(20)]) for i in range(40)] + [None, ""]
    toxic = [int(120 <= i < 160) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 7 and 1, x) for i, x in enumerate(toxic) if i % 2 or i < 120], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(corpus_pipeline.STAGES), docs
    assert list(stages) == ["toxicity", "near_copies", "personal_data", "mixing", "bpe"]

    clean = stages["toxicity"](spark, now, str(tmp_path))
    assert clean.columns == docs.columns and {r["doc_id"] for r in dicts(clean)} == {i for i, x in enumerate(toxic) if not x}
    single = stages["near_copies"](spark, clean, str(tmp_path))
    given = sorted(dicts(clean), key=lambda r: r["doc_id"])
    want = {given[c]["doc_id"] for _, c in brute_components([r["text"] for r in given])}
    assert {r["doc_id"] for r in dicts(single)} == want and single.columns == docs.columns
    private = stages["personal_data"](spark, single, str(tmp_path))
    for r in dicts(private):
        assert r["text"] is None or (not brute_spans(r["text"]) and ("[EMAIL]" in r["text"]) == bool(brute_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"]))
    mixed = stages["mixing"](spark, private, str(tmp_path))
    assert mixed.columns == docs.columns
    assert sorted(r["doc_id"] for r in dicts(mixed)) == sorted(r["doc_id"] for r in dicts(mixing.mix_sources(private)))
    ours = bpe.ForcedBoundaryBpe(bpe.load_tokenizer(queries.tokenizer_path()))
    last = dicts(stages["bpe"](spark, mixed, str(tmp_path)))
    by = {r["doc_id"]: r["text"] for r in dicts(private)}
    assert all(r["token_ids"] == ours.encode(by[r["doc_id"]] or "") for r in last)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in dicts(whole)) == sorted(r["doc_id"] for r in last)
