import pytest

from cohortlens.checks import models as checks
from cohortlens.plans import models


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["elastic_net", "elastic_net_optimality"])
def test_whole_grid_and_hundred_folds(tables, monkeypatch, name):
    def look(data, features, mixes, *_, **__):
        raise Seen(mixes, {r.fold for r in data.select("fold").distinct().collect()})

    monkeypatch.setattr(models, "elastic_net", look)
    with pytest.raises(Seen) as seen:
        getattr(checks, name)(tables)
    mixes, folds = seen.value.args
    assert mixes == [0.1, 0.5, 0.7, 0.9, 0.95, 0.975, 0.99, 0.995, 1.0]
    # The small table has few students, so not every fold has a row; with ten folds none is above 9.
    assert len(folds) > 10 and min(folds) >= 0 and 9 < max(folds) < 100
