"""The fits against plain loops over their definitions."""

import math

import numpy as np

from foretide.llm import quality, toxicity


def plain_nnpu(x, positive, unlabelled, prior, steps, rate=0.1, decay=1e-4):
    """Adam on the non-negative risk, summed row by row."""
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    size = x.shape[1] + 1
    theta = [0.0] * (size - 1) + [math.log(prior / (1 - prior))]
    m, v, turned = [0.0] * size, [0.0] * size, 0
    for t in range(1, steps + 1):
        bracket, plus, minus = 0.0, [0.0] * size, [0.0] * size
        for row, p, u in zip(x, positive, unlabelled):
            full = [*row, 1.0]
            z = sum(a * b for a, b in zip(full, theta))
            s = 1 / (1 + math.exp(-z))
            share = u / n_u - prior * p / n_p
            bracket += math.log1p(math.exp(z)) * share
            for k, a in enumerate(full):
                plus[k] += prior * p / n_p * (s - 1) * a
                minus[k] += share * s * a
        turned += bracket < 0
        for k in range(size):
            g = -minus[k] if bracket < 0 else plus[k] + minus[k]
            g += decay * theta[k] if k < size - 1 else 0.0
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            theta[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return theta, turned


def test_nnpu_equals_plain_risk_and_gradient():
    rng = np.random.default_rng(6)
    n, turned = 60, 0
    for prior in (0.1, 0.3, 0.6):
        x = (rng.random((n, 4)) < 0.4).astype(float)
        positive = (rng.random(n) < 0.3).astype(float)
        x[positive == 1, 0] = 1.0
        unlabelled = (rng.random(n) < 0.7).astype(float)
        if prior > 0.5:  # a prior that the unlabelled texts do not bear out
            x[:, 0], unlabelled = positive, 1 - positive
        rows, cols = np.nonzero(x)
        w, b = toxicity.nnpu_fit(rows, cols, positive, unlabelled, 4, prior, steps=80)
        want, back = plain_nnpu(x, positive, unlabelled, prior, 80)
        turned += back
        assert np.allclose(np.append(w, b), want, atol=1e-8)
    assert turned  # the risk's bracket turned negative in some step


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(8)
    alpha, beta, l1, l2, bits = 2.0, 1.0, 0.2, 0.1, 6
    rows = []
    for _ in range(80):
        index = np.sort(rng.choice(1 << bits, 7, replace=False))
        rows.append((index, rng.random(7), int(3 in index or rng.random() < 0.3)))
    model = quality.train(iter(rows), bits, 400, alpha, beta, l1, l2)
    z, n = {}, {}

    def weight(k):
        zk, keep = z.get(k, 0.0), 0.0 if k == "bias" else l1
        if abs(zk) <= keep:
            return 0.0
        return -(zk - math.copysign(keep, zk)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    for _ in range(5):
        for index, value, label in rows:
            x = {**dict(zip(index.tolist(), value.tolist())), "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
            for k, xk in x.items():
                g = (p - label) * xk
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {k: weight(k) for k in z if k != "bias" and weight(k)}
    assert model.index.tolist() == sorted(want)
    assert np.allclose(model.weight, [want[k] for k in sorted(want)], atol=1e-5)
    assert abs(model.bias - weight("bias")) < 1e-9
