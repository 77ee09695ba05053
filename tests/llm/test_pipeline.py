"""The pipeline's stages, each on its own input and all in a row."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sparkvault.llm import pii
from sparkvault.llm._common import materialize


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abdeilmnorst") for _ in range(r.randrange(2, 7)))
    prose = lambda n=90: " ".join(word() for _ in range(n))
    base = prose()
    rows = [(i, prose(), "en", "s1", 0) for i in range(20)]
    rows += [(100, base, "en", "s2", 0), (101, base + " tail", "en", "s2", 0), (102, base, "en", "s2", 0)]
    rows += [(200, None, "en", "s2", 0), (201, "", "en", "s2", 0), (202, "short", "en", "s2", 0), (203, "a b c " * 60, "en", "s2", 0), (204, " ".join(map(str, range(100, 200))), "en", "s2", 0)]
    rows += [(300, prose() + " write to bob.ray@mail.example.com now", "en", "s2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    ids, current = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        current = materialize(stage(spark, current, ""), "t")
        if i < 4:
            assert current.columns == docs.columns
        ids.append({r.doc_id for r in current.select("doc_id").collect()})
    clean = set(range(20)) | {300}
    assert ids[0] == clean | {100, 101, 102, 204}
    assert ids[1] == clean | {100, 101, 102}
    assert ids[2] == ids[3] == ids[4] == clean | {100}
    assert current.count() == len(clean) + 1


def test_near_copies_from_four_fifths_go(spark):
    words = [f"w{i}" for i in range(200)]
    edited = [f"e{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]  # 176 of 216 shingles are common
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_personal_data_goes_and_clean_text_stays(spark, docs):
    out = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    for r in docs.collect():
        if r.doc_id == 300:
            assert "bob.ray" not in out[300].text and len(pii.find(out[300].text)) == 1 and out[300].n_chars == len(out[300].text)
        elif r.doc_id != 204:
            assert out[r.doc_id].text == r.text
    assert sorted(out) == sorted(r.doc_id for r in docs.collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_run_equals_the_stages_by_brute_force(spark, sf):
    """Quality rules, near-duplicates and pieces by plain loops; languages and surrogates by their operators."""
    from test_operators import brute_components, brute_counts

    from sparkvault.llm import bpe, langid
    from sparkvault.llm.queries import tokenizer_path

    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.collect()
    counts = {r.doc_id: brute_counts(r.text) for r in rows}
    hosts = {}
    for r in rows:
        hosts.setdefault(r.source, []).append(counts[r.doc_id][-1])
    rates = [sum(x) / len(x) for h, x in hosts.items() if h is not None]
    mean = sum(rates) / len(rates)
    var = sum((x - mean) ** 2 for x in rates) / len(rates)
    prior = max(mean * (1 - mean) / var - 1 if var else 0, 1)
    bad = {h for h, x in hosts.items() if h is not None and (sum(x) + mean * prior) / (len(x) + prior) > 0.5}
    passed = [r for r in rows if not counts[r.doc_id][-1] and r.source not in bad]
    kept = spark.createDataFrame(passed, table.schema)
    known = {r.doc_id for r in langid.predict(kept, langid.fit(kept)).filter("lang_pred <> 'und' and score >= 0.5").collect()}
    texts = sorted((r.doc_id, r.text) for r in passed if r.doc_id in known)
    ids = {i for i, _, _, k in brute_components(texts, 80) if k}
    private = {r.doc_id: r.text for r in pii.pseudonymise(table.filter(table.doc_id.isin(list(ids))), corpus_pipeline.PII_KEY).collect()}
    coder = bpe.load_tokenizer(tokenizer_path())
    want = {i: len(coder.encode(private[i], add_special_tokens=False).ids) + 1 for i in ids}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_empty(spark, docs):
    current = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        current = materialize(stage(spark, current, ""), "t")
        assert current.count() == 0
