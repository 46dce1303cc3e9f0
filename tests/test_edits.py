"""Edits from forward and backward tables against enumeration; long lattices."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from strophe.operators import edits, lattice
from tests.test_sequences import brute_forward, matrix


@pytest.mark.parametrize("frames", [1, 2, 3, 5])
@pytest.mark.parametrize("accepted", [[[1]], [[1], [1]], [[1], [2]], [[1, 2], [2]], [[1, 2], [1, 2]], [[1], [2, 3], [1]], [[1, 2, 3], [3], [3, 1]]])
def test_every_edit_equals_enumeration(frames, accepted):
    rng = random.Random(frames * 100 + len(accepted))
    m = matrix(rng, frames, 4)
    whole, total, gone = edits.edit_table(np.array(m), accepted, np.array([1, 2, 3]))

    def mass(choices):
        found = [brute_forward(m, list(c)) for c in itertools.product(*choices)]
        return sum(math.exp(v) for v in found if v is not None)

    close = lambda got, want: math.exp(got) == pytest.approx(want, abs=1e-12)
    assert close(whole, mass(accepted))
    for p in range(len(accepted)):
        assert close(gone[p], mass(accepted[:p] + accepted[p + 1:]))
        for i, c in enumerate((1, 2, 3)):
            assert close(total[p, i], mass([*accepted[:p], [c], *accepted[p + 1:]]))


def test_forty_positions_of_two_ways(spark):
    """2^40 pronunciations: the mean over them is what it is for one where both ways look alike."""
    rng = random.Random(4)
    twin = [[v[0], v[1], v[1], v[2]] for v in matrix(rng, 100, 3)]
    acc = [[1, 2] if i % 2 == 0 else [3] for i in range(80)]
    mats = spark.createDataFrame([(1, twin), (2, twin[:3])], "event long, matrix array<array<double>>")
    both = spark.createDataFrame([(1, acc), (2, acc)], "event long, accepted array<array<int>>")
    out = {r["position"]: r for r in lattice.variant_marginal(mats, both, "event", [1, 2, 3]).collect()}
    single = spark.createDataFrame([(1, [a[:1] for a in acc])], "event long, accepted array<array<int>>")
    want = {r["position"]: r for r in edits.edit_scores(mats, single, "event", "accepted", [1, 2, 3]).where("position IS NULL").collect()}
    got = {r["position"]: r for r in edits.edit_scores(mats, both, "event", "accepted", [1, 2, 3]).where("position IS NULL AND event = 1").collect()}
    assert len(out) == 80 and all(math.isfinite(r["gop"]) for r in out.values())
    assert got[None]["log_score"] == pytest.approx(want[None]["log_score"], abs=1e-9)


def test_odd_events(spark):
    mats = spark.createDataFrame([(1, [[-0.5, -1.0]]), (2, []), (3, [[-1e300, -0.1], [-0.2, -1e300]])], "event long, matrix array<array<double>>")
    acc = spark.createDataFrame([(1, []), (2, [[1]]), (3, [[1, 1]]), (4, [[1]])], "event long, accepted array<array<int>>")
    rows = {(r["event"], r["position"], r["candidate"]): r["log_score"] for r in edits.edit_scores(mats, acc, "event", "accepted", [1]).collect()}
    assert rows.pop((1, None, -2)) == pytest.approx(-0.5)
    assert rows.pop((3, None, -2)) == pytest.approx(-0.1 - 0.2)
    assert rows == {(2, None, -2): None, (2, 0, -1): None, (3, 0, -1): None}
