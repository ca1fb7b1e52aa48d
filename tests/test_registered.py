"""A few registered queries against their SQL on the smallest tables."""

import os

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "jaccard_topk", "jaccard_expected_rank_hot", "compact_profiles", "maxsim_expected_rank",
    "episode_ranks_partial", "embed_mean", "runtime_stream_match", "expected_labels",
]


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"whiten_apply", "whiten_maxsim"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    result, _, _ = compare(spark, connect(FOLDER), name, FOLDER)
    assert result.startswith("ok"), result
