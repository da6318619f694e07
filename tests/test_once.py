"""Captures are dealt out before they are parsed, and a page is parsed once."""

import pytest

from lotewise.plans import captures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "sign", "times"), [("msys_detail_pages", "__NEXT_DATA__[", 1), ("kenlo_detail_pages", r"markoVars\['", 1), ("msys_site_pages", "__NEXT_DATA__[", 2)])
def test_a_page_is_parsed_where_it_was_dealt(spark, name, sign, times):
    """The pattern that finds a page's data is in the plan once (twice where two operators read the page), and not below the exchange."""
    plan = getattr(captures, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(sign) == times and sign not in plan.split("Repartition")[-1]


def test_captures_are_spread(spark, monkeypatch):
    monkeypatch.setattr(captures, "CAPTURES", 20)
    made = captures._captures(spark, SF, "concat('<p>', p_size)")
    assert made.rdd.getNumPartitions() == -(-made.count() // 20) > 1
