"""The registered text queries against their SQL, and the pipeline stage by stage."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from timelens.llm import decontaminate, jaccard, queries, quality, sharding
from timelens.llm.tables import read_table, settle
from verification.compare import canonical, sql_connection

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    found = queries.queries()[name](spark, SF_DIR).toPandas()
    wanted = sql_connection(SF_DIR).execute(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)


def test_everything_is_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.queries()} <= names
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")].__len__() == 13


def test_pipeline_by_stages(spark):
    """Every stage keeps what the operator's verdicts on the stage's own input say."""
    docs = read_table(spark, SF_DIR, "documents")
    labels, benchmark = read_table(spark, SF_DIR, "labels"), read_table(spark, SF_DIR, "benchmark")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, SF_DIR), name)
        if name != "sharding":
            assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out

    def ids(frame, condition=None):
        frame = frame.filter(condition) if condition else frame
        return sorted(r.doc_id for r in frame.collect())

    (given, good), (_, single), (_, clean), (_, mixed), (_, placed) = kept
    assert ids(good) == ids(quality.judge_quality(given, labels), "predicted = 1")
    assert ids(single) == ids(jaccard.link_documents(good), "doc_id = component_id")
    assert ids(clean) == ids(decontaminate.judge_contamination(single, benchmark), "NOT contaminated")
    assert set(ids(mixed)) <= set(ids(clean)) and max(map(ids(mixed).count, ids(mixed))) <= 2
    assert ids(placed) == ids(mixed)
    assert ids(placed) == ids(sharding.shard_documents(mixed))
    words = [sum(len((r.text or "").split()) for r in f.collect()) for f in (clean, mixed)]
    assert abs(words[1] / words[0] - 1.5) < 0.1
