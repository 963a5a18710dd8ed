import pytest
from pyspark.sql import functions as F

from shelfmetrics.functions.ratings import car, check_prior, wilson
from shelfmetrics.operators import ratings

SCHEMA = "query string, parent_asin string, average_rating double, rating_number long"


def value(spark, r, v, c=4.0, m=50.0):
    row = spark.createDataFrame([(r, v)], "r double, v long").select(car(F.col("r"), F.col("v"), F.lit(c), F.lit(m)))
    return row.first()[0]


def test_car_edges(spark):
    assert value(spark, 5.0, None) is None
    assert value(spark, None, 0) == 4.0
    assert value(spark, 5.0, 50) == 4.5
    assert 4.0 < value(spark, 5.0, 1) < 4.1


@pytest.mark.parametrize(("c", "m"), [(0.5, 10), (5.1, 10), (4, 0), (4, -1)])
def test_prior_is_checked(c, m):
    with pytest.raises(ValueError):
        check_prior(c, m)


def test_contradictions_are_refused(spark):
    rows = spark.createDataFrame([("q", "A", None, 3), ("q", "B", 4.0, -1), ("q", "C", 4.0, 1)], SCHEMA)
    with pytest.raises(ratings.Contradictions, match="A: .*B: "):
        ratings.refuse_contradictions(rows)


def test_priors_switch_at_thirty_rated(spark):
    rows = [("big", f"A{k}", 4.0, k + 1) for k in range(30)] + [("small", f"B{k}", 4.0, 5) for k in range(29)] + [("small", "BX", None, None)]
    found = {r["query"]: r for r in ratings.priors_for(spark.createDataFrame(rows, SCHEMA), (3.5, 50.0)).collect()}
    assert (found["big"]["C"], found["big"]["m"], found["big"]["flagged"]) == (4.0, 15.5, False)
    assert (found["small"]["C"], found["small"]["m"], found["small"]["flagged"], found["small"]["n_rated"]) == (3.5, 50.0, True, 29)


def test_rank_ties_and_unknown_last(spark):
    rows = [("q", "B", 4.0, 10), ("q", "A", 4.0, 10), ("q", "N", None, None), ("q", "C", 4.0, 99)]
    priors = spark.createDataFrame([("q", 4.0, 50.0, "fallback")], "query string, C double, m double, source string")
    order = [r["parent_asin"] for r in ratings.ranked(spark.createDataFrame(rows, SCHEMA), priors).orderBy("rank").collect()]
    assert order == ["C", "A", "B", "N"]


def test_wilson(spark):
    low, high = wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(81, 87), (0, 0)], "k long, n long").select(low, high).collect()
    assert [round(x, 3) for x in rows[0]] == [0.858, 0.968]
    assert all(x != x for x in rows[1])
