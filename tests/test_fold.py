"""Effects of pieces of the weight fold, listed and tabled, against walking the decisions."""

import numpy as np
import pytest

from plumbline.operators import review as RV


@pytest.fixture(scope="module")
def table():
    return RV.reachable()[1]


def walked(steps, at, decisions):
    for d in decisions:
        at = int(steps[int(d)][at])
    return at


@pytest.mark.parametrize("listed", [1, 9, 60, RV.LISTED])
def test_effects_compose(table, monkeypatch, listed):
    monkeypatch.setattr(RV, "LISTED", listed)
    rng, rows = np.random.default_rng(5), table.tolist()
    runs = [rng.random(n) < 0.5 for n in (1, 8, 30, 17, 25)]
    packed = []
    for run in runs:
        effect = RV._Run(table)
        for part in np.array_split(run, 3):
            effect.add(part)
        packed.append(effect.packed())
    whole = RV._Run(table)
    for one in packed:
        whole.then(one)
    for at in (0, 1, 77, table.shape[1] - 1):
        assert [RV._state_after(p, at, rows) for p in packed] == [walked(table, at, r) for r in runs]
        assert RV._state_after(whole.packed(), at, rows) == walked(table, at, np.concatenate(runs))


def test_a_short_piece_is_no_larger_than_its_decisions(table):
    effect = RV._Run(table)
    effect.add(np.ones(25, bool))
    assert len(effect.packed()) < 16
