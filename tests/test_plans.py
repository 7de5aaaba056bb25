"""Physical plans: no nested-loop or cartesian joins in pair operators, filters and columns at the scan."""

import contextlib
import io

import pytest

from lodestrand import catalog


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["target_pairs", "pairwise_task", "panel_overlap", "similar_items", "bucket_overlap", "paired_models", "six_way_join"])
def test_no_cartesian(name, spark, data):
    p = plan(catalog.QUERIES[name](spark, data))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_is_pruned(spark, data):
    p = plan(catalog.QUERIES["six_way_join"](spark, data))
    assert "EqualTo(l_returnflag,R)" in p and "l_comment" not in p
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in p
