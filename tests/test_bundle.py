"""The correlation bundle against numpy, and its empty and constant cases."""

import numpy as np
import pytest

from tidewatt.operators import bundle

OBS = "station string, at long, fuel string, output_mw double, uigf_mw double, capped boolean, quality string"


def test_bundle_against_numpy(spark):
    rng = np.random.default_rng(5)
    n, lag = 160, 3
    x = np.cumsum(rng.normal(size=n))
    y = np.roll(x, lag) + rng.normal(scale=0.05, size=n)
    obs = [("w", 300 * i, "wind", 0.0, float(y[i]), True if i % 11 == 0 else None if i % 13 == 0 else False, "partial" if i % 17 == 0 else "ok") for i in range(n)]
    weather = [("w", "speed", 300 * i, float(x[i])) for i in range(0, n, 2)] + [("w", "speed", 300, None), ("w", "bare", 0, float("nan")), ("q", "speed", 0, 1.0)]
    obs += [("c", 300 * i, "hydro", 7.0, None, False, "ok") for i in range(9)] + [("m", 0, "wind", 1.0, 1.0, None, "ok")]
    weather += [("c", "speed", 300 * i, float(i)) for i in range(9)]
    got = {(r.station, r.variable): r for r in bundle.correlated(spark.createDataFrame(obs, OBS), spark.createDataFrame(weather, "station string, variable string, at long, value double"), 8).collect()}
    assert set(got) == {("w", "speed"), ("c", "speed"), ("m", None)}

    used = np.array([o[5] is False and o[6] == "ok" for o in obs[:n]])
    line = np.interp(np.arange(n), np.arange(0, n, 2), x[::2])
    known = np.arange(n) <= n - 2  # nothing is known after the last sample
    target = np.where(used, y, np.nan)
    w = got["w", "speed"]
    both = known & used
    assert (w.n_total, w.n_used, w.n_pairs, w.target, w.target_constant) == (n, used.sum(), both.sum(), "uigf_mw", False)
    assert w.capped_fraction == pytest.approx(sum(o[5] is True for o in obs[:n]) / n) and w.masked_fraction == pytest.approx(1 - used.mean())
    assert w.pearson == pytest.approx(np.corrcoef(line[both], y[both])[0, 1])
    rank = lambda v: np.argsort(np.argsort(v))
    assert w.spearman == pytest.approx(np.corrcoef(rank(line[both]), rank(y[both]))[0, 1])
    cells, _, _ = np.histogram2d(line[both], y[both], bins=20)
    p = cells / cells.sum()
    of = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    assert w.bits == pytest.approx((p[p > 0] * np.log2(p[p > 0] / of[p > 0])).sum())

    def at(k):
        i = np.arange(max(0, -k), n - max(0, k))
        i = i[known[i] & ~np.isnan(target[i + k])]
        return abs(np.corrcoef(line[i], target[i + k])[0, 1])

    strengths = {k: at(k) for k in range(-8, 9)}
    assert w.peak_lag == max(strengths, key=strengths.get) == lag
    assert w.prominence == pytest.approx(max(strengths.values()) - min(strengths.values()))

    c, m = got["c", "speed"], got["m", None]
    assert (c.target, c.target_constant, c.n_pairs, c.pearson, c.spearman, c.bits, c.peak_lag) == ("output_mw", True, 9, 0.0, 0.0, 0.0, None)
    assert (m.n_used, m.target, m.target_constant, m.masked_fraction) == (0, None, False, 1.0)
