"""Graph queries without SQL cover the whole road graph; held against a plain search."""

from collections import defaultdict

from streetflow.plans import catalog
from streetflow.plans.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def plain_components(nodes, links):
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {x: reach(x) for x in nodes}
    return {x: min(y for y in far[x] if x in far[y]) for x in nodes}


def test_components_of_the_whole_graph(spark):
    fx = Fixtures(spark, SF)
    links = [(r.begin_node_id, r.end_node_id) for r in fx["road_links_raw"].collect()]
    nodes = [r.node_id for r in fx["road_nodes"].collect()]
    got = {r.node: r.component for r in catalog.queries()["scc_road"](spark, SF).collect()}
    assert got == plain_components(nodes, links)


def test_destinations_range_over_all_nodes(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    n = fx["road_nodes"].count()
    od = catalog.od_whole(fx)
    assert od.count() == n and od.select("dest").distinct().count() == n
    clusters = {r.node for r in catalog.queries()["spectral_clusters"](spark, "/root/testdata/sf0.01").collect()}
    assert len(clusters) > 200
