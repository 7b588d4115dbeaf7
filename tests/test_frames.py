"""Arrivals of runs that lie in many blocks, against a plain pass over each run."""

import numpy as np

from tomolake.streaming import frames


def plain(run, ratio, share=0.15, apart=10, tolerance=0.05):
    p_step, top_p, top_s = None, 0.0, 0.0
    for step, p, _ in run:
        top_p = max(top_p, abs(p))
        if p_step is None and (abs(p) > 1e-9 or abs(p) > max(1e-10, 0.01 * top_p)):
            p_step = step
    for step, p, s in run:
        top_s = max(top_s, abs(s))
        if p_step and step >= p_step + apart and abs(s) > share * top_s and abs(s) > abs(p) and 1.3 <= step / p_step <= 2.8 and abs(step / p_step - ratio) <= tolerance * ratio:
            return p_step, step
    return p_step, None


def test_arrivals_over_many_blocks(spark):
    rng, rows, want = np.random.default_rng(3), [], set()
    for run in range(12):
        n = 40 if run % 3 else 900
        p, s = rng.normal(0, 1, n) * (rng.random(n) < 0.7), rng.normal(0, 1, n) * np.exp(rng.normal(0, 2, n))
        p[: 30 + 5 * run] = rng.choice([0, 5e-11, 3e-10], 30 + 5 * run, p=[0.9, 0.08, 0.02])[: len(p[: 30 + 5 * run])]
        own = [(int(i + 1), float(p[i]), float(s[i])) for i in range(n)]
        rows += [(run, *r) for r in own]
        want.add((run, *plain(own, 1.7)))
    rows.append((99, 1, 0.0, 0.0))
    f = spark.createDataFrame(rows, frames.STEP).repartition(6)
    arrived = frames.p_arrivals(f)
    assert {(r["run_id"], r["p_step"]) for r in arrived.collect()} == {w[:2] for w in want} | {(99, None)}
    got = {tuple(r) for r in frames.s_arrivals(f, arrived, 1.7).collect() if r["run_id"] != 99}
    assert got == want and len({w[2] for w in want}) > 2
