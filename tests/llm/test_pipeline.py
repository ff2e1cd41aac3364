"""Every stage of the pipeline against a plain version of it."""

import importlib.util

import pytest

from tests.llm.fixtures import odd_docs
from tests.llm.test_packing import check
from tests.llm.test_setsketch import plain_components
from tokenloom.llm import quality, toxicity
from tokenloom.llm.registry import table

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    from corpus_pipeline import GOOD, ORACLE_SQL, STAGES, TOXIC, run

    assert ORACLE_SQL is None and [name for name, _ in STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    stages, columns = dict(STAGES), docs.columns

    lexicon = toxicity.learn(docs, labels)
    kept = stages["toxicity"](spark, docs, SF_DIR)
    assert kept.columns == columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows == {r.doc_id: r.text for r in docs.collect() if lexicon.score(r.text) < TOXIC} and len(rows) < docs.count()

    voters = quality.learn(kept, labels)
    good = stages["quality"](spark, kept, SF_DIR)
    want = {r.doc_id: r.text for r in quality.score(kept, voters).collect() if r.score >= GOOD}
    rows = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and rows == want and len(rows) < kept.count()

    single = stages["near_duplicates"](spark, good, SF_DIR)
    want = {i: rows[i] for i, _, component in plain_components(sorted(rows.items())) if component is None or component == i}
    rows = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and rows == want

    packed = run(spark, SF_DIR).collect()
    check(list(rows.items()), packed, 1 << 18)


def test_odd_rows_pass_through(spark, tmp_path):
    from corpus_pipeline import STAGES

    spark.createDataFrame([(3, 1, 0), (2, 0, 1)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    df, rows = odd_docs(spark)
    for _, stage in STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        assert {r.doc_id for r in out.collect()} <= {i for i, _ in rows}
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert STAGES[-1][1](spark, df, str(tmp_path)).count() == len(rows)
