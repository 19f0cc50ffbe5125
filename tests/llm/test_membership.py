"""Rows picked by id against plain sets, with roomy and with filled bitmaps."""

import pytest

from loomline.llm import membership
from loomline.llm.shared import save


@pytest.mark.parametrize("most", [membership.MOST_BITS, 8])
def test_exact(spark, monkeypatch, most):
    """A bitmap with every bit set lets all rows through to the exact join; the result is the same."""
    monkeypatch.setattr(membership, "MOST_BITS", most)
    there = [None, None, 0, -1, 2**63 - 1, -(2**63), *range(1, 3000), *[5, 6] * 50]
    rows = spark.createDataFrame([(x, f"t{n}", "s") for n, x in enumerate(there)], "doc_id long, text string, node string")
    for wanted in (set(), {5}, {0, -1, 2**63 - 1, 10**12}, set(range(-10, 2000)), {x for x in there if x is not None}):
        ids = save(spark.createDataFrame([(x,) for x in wanted], "doc_id long"), "ids")
        texts = {f(rows, ids, "doc_id"): None for f in (membership.likely, membership.among, membership.without)}
        likely, among, without = ([r["text"] for r in df.collect()] for df in texts)
        assert all(df.columns == rows.columns for df in texts)
        own = sorted(f"t{n}" for n, x in enumerate(there) if x in wanted)
        assert sorted(among) == own and set(own) <= set(likely)
        assert sorted(without) == sorted(f"t{n}" for n, x in enumerate(there) if x not in wanted)
        assert most == 8 or len(likely) <= len(own) + 0.05 * len(there)


def test_ids_of_other_types(spark):
    """Whole numbers of another width are the same ids."""
    rows = spark.createDataFrame([(k,) for k in range(50)], "doc_id int")
    ids = save(spark.createDataFrame([(k,) for k in range(0, 60, 7)], "doc_id long"), "ids")
    assert sorted(r[0] for r in membership.among(rows, ids, "doc_id").collect()) == list(range(0, 50, 7))
    assert membership.without(rows, ids, "doc_id").dtypes == [("doc_id", "int")]
