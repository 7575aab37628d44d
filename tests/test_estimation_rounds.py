"""The registered estimation queries run the whole loop."""

import pytest

from streetflow.operators import estimate as est
from streetflow.plans import catalog


class Called(Exception):
    pass


@pytest.mark.parametrize("name", ["estimate", "estimate_hourly", "estimate_relative", "cv_errors", "learning_curve", "kernel_sweep"])
def test_twenty_rounds(name, spark, monkeypatch):
    def by(collapsed, key, g, max_iter=20, scheme=None, relative=False):
        raise Called(max_iter)

    def cv(trips, g, k, max_iter, sizes=None, schemes=None):
        raise Called(max_iter)

    monkeypatch.setattr(est, "estimate_by", by)
    monkeypatch.setattr(est, "cross_validate", cv)
    for x in ("collapsed_by", "matched_folds", "road_graph"):
        monkeypatch.setattr(catalog, x, lambda *a: None)
    with pytest.raises(Called) as e:
        catalog.REGISTRY[name][0](None)
    assert e.value.args == (20,)
