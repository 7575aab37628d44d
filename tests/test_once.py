"""What is made once: the links of a graph, the trips of an estimate, and the formulas that the validity tests read."""

from streetflow.functions import trips as trip
from streetflow.operators import estimate as est, routing
from streetflow.plans.fixtures import Fixtures
from tests.test_graph import lattice
from tests.test_spread_loops import trips


def counted(spark, df):
    """df, and an accumulator of the rows that are made for it."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), made


def test_the_links_of_a_graph(spark):
    links = spark.createDataFrame([(1, 2, 5.0, 1.0), (1, 2, 6.0, 0.5), (2, 3, 7.0, 1.0)], "begin_node_id long, end_node_id long, street_length double, time double")
    links, made = counted(spark, links)
    g = routing.load_graph(links)
    assert g.time.tolist() == [0.5, 1.0] and g.length.tolist() == [6.0, 7.0] and made.value == 3


def test_the_trips_of_an_estimate(spark):
    g, _ = lattice()
    rows, made = counted(spark, trips(spark))
    assert est.estimate_by(rows, "slice", g, 1).count() and made.value == 120


def test_the_formulas_of_validity(spark):
    t = Fixtures(spark, "/root/testdata/sf0.001")["trips"]
    plan = t.where(trip.validity() == 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("7919") < 20
