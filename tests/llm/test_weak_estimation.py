"""Estimation of labellers with the production weight of the expected votes."""

import inspect

import numpy as np
import pytest

from strandline.llm import weak_labels


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_known_accuracies_are_recovered_by_default(n):
    rng = np.random.default_rng(1)
    truth = rng.random(n) < 0.9
    accuracy = np.linspace(0.65, 0.97, len(weak_labels.LABELLERS))
    right = rng.random((n, len(accuracy))) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = weak_labels.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, share, rates = weak_labels.estimate(patterns, counts.astype(float))
    assert share == pytest.approx(0.9, abs=0.02)
    for y in (weak_labels.BAD, weak_labels.GOOD):
        found = rates[y, :, y] / (rates[y, :, 0] + rates[y, :, 1])
        assert np.abs(found - accuracy).max() < 0.05
    assert inspect.signature(weak_labels.estimate).parameters["weight"].default == weak_labels.BELIEF
