"""The pipeline keeps the columns of documents, and every stage's decisions take effect."""

import corpus_pipeline
import pytest

from reachspark.llm import queries
from reachspark.session import cut

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = queries.read(spark, FOLDER, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(last) == docs.count() and sorted(map(tuple, last)) == sorted(map(tuple, whole))


@pytest.mark.parametrize("n", range(1, 14))
def test_each_number_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
