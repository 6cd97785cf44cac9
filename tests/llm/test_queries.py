"""The queries of the subpackage run over whole tables."""

import pytest

from lodestone.llm.queries import R

WANT = {"p1_found": ["file"], "p2_found": ["file"], "p4_found": ["file", "line"], "p6_found": ["vec_a", "vec_b"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_pos", "end_pos"]}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_runs(spark, data, name):
    df = R.queries[name](spark, data)
    assert df.count() > 0 or name in ("p4_found", "p2_found", "p6_found")
    assert df.columns == WANT.get(name, df.columns)
