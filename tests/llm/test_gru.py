import time
import warnings

import numpy as np

from logweave.llm import gru


def least(f, times=20):
    took = []
    for _ in range(times):
        began = time.thread_time()
        f()
        took.append(time.thread_time() - began)
    return min(took)


def test_a_step_costs_little_more_than_its_arithmetic():
    hidden, lanes, steps = 24, 256, 200
    rng = np.random.default_rng(2)
    p = gru.new_params(500, 10, hidden)
    x, h = rng.integers(0, 500, lanes * steps).astype(np.int32), np.zeros((lanes, hidden), np.float32)
    gates, inner = np.zeros((lanes, 2 * hidden), np.float32), p["inner"]

    def arithmetic():
        for _ in range(steps):
            np.matmul(h, inner)
            np.exp(gates)
            np.tanh(h)

    cell = gru._Cell(p, 500)
    assert least(lambda: cell.run(h, x, [lanes] * steps, True)) < 3.4 * least(arithmetic)


def test_saturated_gates_and_large_outputs_stay_finite():
    p = gru.new_params(12, 3, hidden=4)
    p = {k: v * np.float32(5000) for k, v in p.items()}
    symbols, heads = np.arange(12), np.array([0, 5, 12])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert np.isfinite(gru.log_probabilities(p, symbols, heads)).all()
        trainer = gru.Trainer(p)
        trainer.learn(symbols, heads)
    assert all(np.isfinite(v).all() for v in trainer.p.values())
