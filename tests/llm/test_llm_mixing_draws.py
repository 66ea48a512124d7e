"""Draws of source counts: exact law on small urns, and no other way for very large ones."""

from math import comb

import numpy as np
import pytest

from textpace.llm import mixing


def test_draws_follow_the_law_of_an_urn(monkeypatch):
    """Frequencies of the first source's share meet the hypergeometric law, by the root step and by single draws."""
    for single in (2, 64):
        monkeypatch.setattr(mixing, "SINGLE_DRAWS", single)
        rng = np.random.default_rng(11)
        counts, n, runs = np.array([7, 5, 0, 8]), 9, 20_000
        drawn = np.array([mixing.split_counts(counts, n, rng) for _ in range(runs)])
        assert (drawn.sum(axis=1) == n).all() and (drawn <= counts).all() and (drawn >= 0).all()
        want = np.array([comb(7, k) * comb(13, n - k) / comb(20, n) for k in range(8)])
        got = np.bincount(drawn[:, 0], minlength=8) / runs
        assert np.abs(got - want).max() < 0.015


@pytest.mark.parametrize("total", [10**6, 10**9, 10**12, 4 * 10**17])
def test_draws_stray_as_chance_does_at_every_size(total):
    rng = np.random.default_rng(3)
    counts = np.array([total // 2, total // 3, total - total // 2 - total // 3])
    n = total // 5
    parts = np.array([mixing.split_counts(counts, n, rng) for _ in range(200)])
    assert (parts.sum(axis=1) == n).all() and (parts <= counts).all()
    share = counts / total
    spread = np.sqrt(n * share * (1 - share) * (1 - n / total))
    off = (parts - n * share) / spread
    assert np.abs(off.mean(axis=0)).max() < 0.35 and 0.8 < off.std(axis=0).min() and off.std(axis=0).max() < 1.2


def test_shards_add_up_beyond_the_old_limit():
    totals = np.array([3 * 10**11, 10**11, 7])
    size = -(-int(totals.sum()) // 6)
    got = [mixing.shard_counts(totals, s, 6, size, 1) for s in range(6)]
    assert (sum(c for c, _ in got) == totals).all()
    assert all((b == sum((c for c, _ in got[:s]), np.zeros(3, np.int64))).all() for s, (_, b) in enumerate(got))
