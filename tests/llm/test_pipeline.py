"""The pipeline's stages, each against a brute-force version of its own input."""

from collections import Counter

from conftest_llm import prose
from test_text_operators import base_spans, brute_components, brute_targets, fingerprint_of, five_word, likeness_of, words

import corpus_pipeline
from tidewatch.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{sf}/documents.parquet")
    extra = given.limit(1).selectExpr("cast(90001 as bigint) doc_id", "'12 34 !!' text", "'en' lang", "'src0' source", "cast(8 as bigint) n_chars")
    docs = given.unionByName(extra)
    tables = [{(r.doc_id): r for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == COLUMNS
        tables.append(docs.collect() if k >= 3 else {r.doc_id: r for r in docs.collect()})
    first, spoken, single, clean, mixed, tokens = tables
    assert set(first) - set(spoken) == {90001}
    prints = {i: fingerprint_of(r.text) for i, r in spoken.items()}
    roots = brute_components(sorted(set(prints.values())))
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert set(single) <= set(least.values())  # the links of fingerprints at least; similar texts are linked too
    shingles = {i: five_word(spoken[i].text) for i in least.values()}
    for i in set(least.values()) - set(single):
        assert max(likeness_of(shingles[i], shingles[j]) for j in shingles if j != i) > 0.65
    for i, r in single.items():
        changed = bool(base_spans(r.text))
        assert (clean[i].text != r.text) == changed or "[IBAN]" in clean[i].text or "[SSN]" in clean[i].text
        assert clean[i].n_chars == len(clean[i].text)
    sizes, taken = Counter(), Counter()
    for r in clean.values():
        sizes[r.source] += len(words(r.text))
    for r in mixed:
        taken[r.source] += len(words(r.text))
        assert r.text == clean[r.doc_id].text
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20 for s in want) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    t = Tokenizer.from_file(queries.vocabulary_path())
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)
    for r in tokens[:300]:
        ids = t.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "personal_data", "mixing", "tokens"]


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert prose(1) == prose(1)
