"""The pipeline against a plain Python version of its stages, and its guard in the entry points."""

import brute
import corpus_pipeline
import pytest
from oracle import connect
from plumbline.scale import materialise
from test_llm_queries import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows after each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        out[name] = docs
    return out


def test_stages(spark, sf, stages):
    con = connect(sf)
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    tables = [{r.doc_id: r.text for r in stages[n].collect()} for n in names[:-1]]
    for n in names[:-1]:
        assert stages[n].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rules, one, clean, redacted = tables
    assert not any(brute.quality(t)[5] for t in rules.values())
    good = {i for i, q in con.execute("SELECT doc_id, quality FROM labels").fetchall() if q == 1 and not brute.quality(docs[i])[5]}
    assert good <= set(rules)
    near = brute.components(rules.items(), 5, 80)
    assert set(one) == {i for i, (_, c) in near.items() if c == i}
    items = [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    flat = lambda t: " ".join(t.split())
    assert set(clean) == {i for i, t in one.items() if not any(flat(b) in flat(t) for b in items)}
    assert set(redacted) == set(clean)
    for i, t in redacted.items():
        assert ("[secret]" in t) == (t != clean[i]) == (brute.spans(clean[i], brute.SECRETS)[0] > 0 and t != clean[i])
    check_packing(stages["packing"].collect(), redacted)


def test_no_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
