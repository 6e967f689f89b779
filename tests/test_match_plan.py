"""The best candidates are folded where the lists meet: pairs are neither sorted nor sent on, and the part table isn't broadcast."""

import re

import pytest

from tunelode.plans import registry


@pytest.mark.parametrize("name", ["match_tiers_best", "match_tiers_best_whole"])
def test_pairs_are_folded_in_the_join(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    join = final.index("SortMergeJoin")
    assert "Window" not in final and "BroadcastExchange" not in final
    assert not re.search(r"\b(Sort|Exchange|ShuffleQueryStage)\b", final[:join])
