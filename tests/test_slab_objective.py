"""Spline surfaces by the root of the squared errors plus bending, against descent on all points."""

import numpy as np
import pytest

from voxloom.operators import kernels

SCHEMA = "run long, layer string, x double, y double, z double"


def design(p, size, knots):
    x, y = kernels.basis(p[:, 0] / size, knots), kernels.basis(p[:, 1] / size, knots)
    return (y[:, :, None] * x[:, None, :]).reshape(len(p), -1)


def objective(c, a, z, stiffness, knots):
    k = knots * knots
    return np.sqrt(((a @ c - z) ** 2).sum()) + stiffness * c[:k] @ kernels.bending(knots) @ c[:k]


def descended(a, z, stiffness, knots, steps=500, rate=0.1):
    """Adam on every point at each step."""
    k = knots * knots
    c, m, u = np.zeros(a.shape[1]), 0.0, 0.0
    best = np.inf
    for t in range(1, steps + 1):
        e = a @ c - z
        g = a.T @ e / max(np.sqrt((e**2).sum()), 1e-12)
        g[:k] += 2 * stiffness * kernels.bending(knots) @ c[:k]
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        c = c - rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
        best = min(best, objective(c, a, z, stiffness, knots))
    return best


@pytest.mark.parametrize("stiffness", [0.0, 0.5, 200.0])
def test_objective_is_no_worse_than_that_of_descent(spark, stiffness):
    r, knots, size, depth = np.random.default_rng(3), 6, 1000.0, 500.0
    p = r.uniform(0, size, (400, 2))
    top = np.arange(400) % 2 == 0
    z = 250 + 80 * np.sin(2 * np.pi * p[:, 0] / size) + np.where(top, 50, -50) + r.normal(0, 12, 400)
    rows = [(0, "top" if t else "bottom", float(x), float(y), float(h)) for t, (x, y), h in zip(top, p, z, strict=True)]
    f = kernels.spline_fit(spark.createDataFrame(rows, SCHEMA), size, size, knots, stiffness, depth).first()
    a = np.concatenate([design(p, size, knots), top[:, None], ~top[:, None]], 1).astype(float)
    c = np.array([*f.control, f.top, f.bottom]) / depth
    own = objective(c, a, z / depth, stiffness, knots)
    assert own <= descended(a, z / depth, stiffness, knots) + 1e-9
    for _ in range(20):  # nor is any surface near it better
        assert own <= objective(c + r.normal(0, 1e-3, len(c)), a, z / depth, stiffness, knots) + 1e-12


def test_bounds_of_fits(spark):
    r = np.random.default_rng(1)
    p = r.random((120, 2))
    z = 200 + 50 * p[:, 0] - 30 * p[:, 1]
    rows = [(0, "top", float(x * 800), float(y * 800), float(h)) for (x, y), h in zip(p, z, strict=True)]
    f = kernels.spline_fit(spark.createDataFrame(rows, SCHEMA), 800.0, 800.0, 5, 0.0, 400.0).first()
    got = design(p * 800, 800.0, 5) @ np.array(f.control) + f.top
    assert np.sqrt(((got - z) ** 2).mean()) < 10  # and in fact it is the plane
    assert np.sqrt(((got - z) ** 2).mean()) < 1e-3
    p = r.random((200, 2))
    bump = 250 + 80 * np.sin(2 * np.pi * p[:, 0])
    rows = [(0, layer, float(x * 1000), float(y * 1000), float(h + s)) for layer, s in (("top", 50), ("bottom", -50)) for (x, y), h in zip(p, bump, strict=True)]
    f = kernels.spline_fit(spark.createDataFrame(rows, SCHEMA), 1000.0, 1000.0, 5, 0.0, 500.0).first()
    assert abs(f.top - f.bottom - 100) < 0.5


def test_more_stiffness_bends_less(spark):
    r = np.random.default_rng(0)
    p = r.random((150, 2))
    z = 250 + 120 * np.sin(2 * np.pi * p[:, 0]) * np.sin(2 * np.pi * p[:, 1])
    points = spark.createDataFrame([(0, "top", float(x * 1000), float(y * 1000), float(h)) for (x, y), h in zip(p, z, strict=True)], SCHEMA)
    bent = []
    for stiffness in (0.0, 1.0, 200.0):
        c = np.array(kernels.spline_fit(points, 1000.0, 1000.0, 7, stiffness, 500.0).first().control) / 500
        bent.append(c @ kernels.bending(7) @ c)
    assert bent[0] > bent[1] > bent[2]
