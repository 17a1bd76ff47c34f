"""Plans are the ones wanted: filters and columns reach the scan, no cross product, top-k cut before the shuffle."""

import pytest

from quern.plans import relational, selection
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("query", "has", "lacks"),
    [
        (selection.docs_by_source, ["EqualTo(source,src0)", "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>"], ["Exchange"]),
        (selection.docs_in_whitelist, ["In(source,"], ["Exchange", "text:string"]),
        (selection.hot_sources_verified, ["LeftSemi", "TakeOrderedAndProject", "EqualTo(quality,1)"], ["text:string"]),
        (relational.top_k_per_group, ["WindowGroupLimit"], ["o_orderdate"]),
        (relational.join_range, ["_node"], ["CartesianProduct", "BroadcastNestedLoopJoin"]),
        (relational.join_asof, ["Window", "_slice"], ["Cartesian", "NestedLoop"]),
        (relational.join_intervals, ["_node"], ["Cartesian", "NestedLoop"]),
        (relational.REGISTRY.queries["join_inner_star"], ["Join"], ["CartesianProduct", "NestedLoop"]),
    ],
)
def test_plan(spark, query, has, lacks):
    text = plan(query(spark, f"{DATA}/sf0.001"))
    assert all(x in text for x in has), text
    assert not any(x in text for x in lacks), text
