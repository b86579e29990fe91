"""The tagger's emissions against the same steps with the gates side by side in a row, in values and in time."""

from __future__ import annotations

import time

import numpy as np

from turnloom.llm import tagger
from turnloom.llm.tagger import HIDDEN, TAGS


def rowwise(m, x):
    e, by_time = np.empty((x.shape[1], TAGS, len(x)), np.float32), np.ascontiguousarray(x.T).astype(np.intp)
    e[:] = m["bias"][:, None]
    half, one = np.repeat(np.float32([0.5, 1.0]), [3 * HIDDEN, HIDDEN]), np.repeat(np.float32([1.0, 0.0]), [3 * HIDDEN, HIDDEN])
    z, zz, part = np.empty((len(x), 4 * HIDDEN), np.float32), np.empty((len(x), 4 * HIDDEN), np.float32), np.empty((TAGS, len(x)), np.float32)
    h, c, u = (np.empty((len(x), HIDDEN), np.float32) for _ in range(3))

    def tanh(x, scratch):
        np.minimum(x, 3, out=x)
        np.maximum(x, -3, out=x)
        np.multiply(x, x, out=scratch)
        scratch += 3
        np.divide(np.float32(24 / 9), scratch, out=scratch)
        scratch += np.float32(1 / 9)
        x *= scratch

    for side, out in (("l", m["out"][:HIDDEN] * np.float32(0.5)), ("r", m["out"][HIDDEN:] * np.float32(0.5))):
        table, w = m[f"x{side}"] * half, m[f"h{side}"] * half * np.float32(0.5)
        h[:], c[:] = 0, 0
        for t in range(len(e)) if side == "l" else range(len(e) - 1, -1, -1):
            np.take(table, by_time[t], axis=0, out=z, mode="clip")
            np.matmul(h, w, out=zz)
            z += zz
            tanh(z, zz)
            z += one
            c *= z[:, HIDDEN : 2 * HIDDEN]
            np.multiply(z[:, :HIDDEN], z[:, 3 * HIDDEN :], out=u)
            c += u
            c *= 0.5
            np.copyto(h, c)
            tanh(h, u)
            h *= z[:, 2 * HIDDEN : 3 * HIDDEN]
            np.matmul(out.T, h.T, out=part)
            e[t] += part
    return e.transpose(0, 2, 1)


def test_gates_apart_are_equal_and_faster():
    model, x = tagger.trained(), tagger.examples(2048, 5)[0]

    def seconds(f):
        began = time.thread_time()
        f(model, x)
        return time.thread_time() - began

    assert np.abs(rowwise(model, x) - tagger.emissions(model, x)).max() < 1e-4
    runs = [(seconds(rowwise), seconds(tagger.emissions)) for _ in range(7)]
    assert min(b for _, b in runs) < 0.93 * min(a for a, _ in runs)
