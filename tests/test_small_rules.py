"""Rules on texts, times and names, case by case."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import measures as M
from sessionloom.operators import identity, search


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (lambda x: M.utc(x).cast("string"), "2024-03-01T10:00:00+02:00", "2024-03-01 08:00:00"),
        (lambda x: M.utc(x).cast("string"), "2024-03-01T10:00:00.500Z", "2024-03-01 10:00:00.5"),
        (lambda x: M.utc(x).cast("string"), "soon", None),
        (M.relative_seconds, " 1h ", 3600),
        (M.relative_seconds, "7d", 604800),
        (M.relative_seconds, "5", None),
        (lambda x: M.month_range(F.lit(2024), M.month_number(x))["last"], "lutego", "2024-02-29"),
        (lambda x: M.month_range(F.lit(2024), M.month_number(x))["last"], "nothing", None),
        (identity.plausible, "n" * 64, True),
        (identity.plausible, "n" * 65, False),
        (identity.plausible, "a..", False),
        (identity.plausible, "2026_01", True),
        (identity.plausible, "", False),
        (lambda x: F.to_json(search.anchors(x)), "fix-auth (login) a-b-c the the ab", '[{"token":"fix-auth","strong":true},{"token":"login","strong":false},{"token":"a-b-c","strong":false},{"token":"the","strong":false}]'),
        (lambda x: search.readiness(F.lit(1), x == "there", x == "temp", F.lit(0), F.lit(0)), "temp", "pending"),
        (lambda x: search.readiness(F.lit(1), x == "there", x == "temp", F.lit(0), F.lit(3)), "there", "stale_index"),
    ],
)
def test_rule(spark, make, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(make(F.col("x"))).first()[0] == want


def test_fetch_limit():
    assert [search.fetch_limit(3, True), search.fetch_limit(3, False), search.fetch_limit(20, True)] == [50, 3, 200]
