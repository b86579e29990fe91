"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Tags are O and, for each kind, B (first character of a span) and I. Labelled spans are drawn with a fixed seed from
grammars of many forms: those that fixed patterns find, those that they miss (written-out addresses, national telephone
numbers, IPv6, credentials behind a name), and look-alikes that are no personal data (checksums, dates, prices, versions,
settings). ``python -m turnloom.llm.tagger`` trains the model and writes tagger.npz beside this file, which is what
``trained`` reads; the same seed gives the same model up to rounding.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np

#: The kinds of the patterns, in the order of ties, and the kind that the tagger alone finds.
KINDS = ("email", "ip", "card", "phone", "secret")
WINDOW, STRIDE, TRAINING = 512, 416, 144
HIDDEN, CHARS = 12, 131
OTHER, PAD = 128, 129
TAGS = 1 + 2 * len(KINDS)
WEIGHTS = Path(__file__).with_name("tagger.npz")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def codes(text: str) -> np.ndarray:
    """One number per code point."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 128, raw, OTHER).astype(np.uint8)


# ---------------------------------------------------------------- training data


class Maker:
    """Draws texts with labelled spans: parts are (text, kind or None)."""

    #: Names in front of a credential; the others are kept from training.
    NAMES = ("token", "api_key", "apikey", "secret", "password", "passwd", "key", "auth", "access_token", "private_key", "credential", "pwd", "session_key")
    HELD_OUT = ("auth_token", "client_secret", "api-token", "secret_key", "access-key")
    SETTINGS = ("name", "count", "id", "title", "version", "mode", "size", "color", "lang", "page", "width", "path", "level", "index", "total", "status", "sha", "md5", "checksum", "commit", "digest", "etag")

    def __init__(self, seed: int, held_out: bool = False):
        self.rng = np.random.default_rng(seed)
        self.names = self.HELD_OUT if held_out else self.NAMES

    def pick(self, choices):
        return choices[int(self.rng.integers(len(choices)))]

    def run(self, alphabet: str, a: int, b: int | None = None) -> str:
        n = a if b is None else int(self.rng.integers(a, b))
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def number(self, a: int, b: int) -> str:
        return str(int(self.rng.integers(a, b)))

    def word(self) -> str:
        w = self.run(self.pick([LOWER, LOWER, LOWER + "éèêñüöäßçàíóú"]), 1, 11)
        u = self.rng.random()
        return w.upper() if u < 0.04 else w.capitalize() if u < 0.16 else w + self.pick(["!!", "***", "###", "$$$", "%%%", "&&&", "?", "|"]) if u < 0.2 else w

    def email(self) -> str:
        local = self.run(LOWER, 2, 10) + self.pick(["", ".", "_", "-", "+"]) + self.pick([self.run(DIGITS, 1, 4), self.run(LOWER, 2, 9)])
        host = self.run(LOWER, 3, 9) + self.pick(["", "", self.run(DIGITS, 1, 3)]) + self.pick(["", "", "-" + self.run(LOWER, 2, 6)])
        tld = self.pick(["com", "org", "net", "example.com", "co.uk", "de", "io", "edu"])
        at, dot = self.pick([("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", ".")])
        return local + at + host + dot + tld.replace(".", dot)

    def ip(self) -> str:
        if self.rng.random() < 0.75:
            return ".".join(self.number(0, 256) for _ in range(4))
        groups = [self.run("0123456789abcdef", 1, 5) for _ in range(8)]
        if self.rng.random() < 0.5:
            cut = int(self.rng.integers(2, 6))
            return ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 1 : cut + 2])
        return ":".join(groups)

    def card(self) -> str:
        n = self.run(DIGITS, self.pick([15, 16, 16, 16, 16]))
        sep = self.pick(["", "", "", " ", "-"])
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4))

    def phone(self) -> str:
        d = lambda n: self.run(DIGITS, n)
        return self.pick([
            lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{self.number(20, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 {d(3)}.{d(3)}.{d(4)}",
            lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{self.number(20, 99)}{d(9)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"+{self.number(30, 50)} (0) {d(3)} {d(6)}", lambda: f"{d(3)} {d(3)} {d(4)}",
        ])()

    def secret(self) -> str:
        return self.pick([
            lambda: self.run("0123456789abcdef", 24, 65), lambda: self.run("0123456789abcdef", 40), lambda: self.run(LOWER + UPPER + DIGITS, 20, 44), lambda: self.run(LOWER + UPPER + DIGITS + "+/", 24, 48) + self.pick(["", "=", "=="]),
            lambda: self.run(LOWER + UPPER + DIGITS + "!#%^*_-", 9, 20), lambda: "AKIA" + self.run(UPPER + DIGITS, 16), lambda: "ghp_" + self.run(LOWER + UPPER + DIGITS, 36), lambda: "sk-" + self.run(LOWER + UPPER + DIGITS, 32),
        ])()

    def named_secret(self) -> list[tuple[str, int]]:
        quote, value = self.pick(['"', '"', "'", ""]), self.secret()
        if value.startswith(("AKIA", "ghp_", "sk-")) and self.rng.random() < 0.5:
            return [(value, 4)]
        name = self.pick(self.names)
        name = name.upper() if self.rng.random() < 0.15 else name
        return [(name + self.pick([" = ", "=", ": ", " : ", ":"]) + quote, -1), (value, 4), (quote, -1)]

    def noise(self) -> str:
        """Shouting, echoes and tables, as in junk pages."""
        words = [self.word() for _ in range(int(self.rng.integers(1, 4)))]
        again = words * int(self.rng.integers(2, 9))
        style = self.rng.random()
        if style < 0.4:
            mark = self.pick(["!!", "!!", "!", "***", "$$$"])
            return " ".join(w.upper() + mark for w in again)
        return (" " if style < 0.8 else " | ").join(again)

    def decoy(self) -> str:
        if self.rng.random() < 0.2:
            return self.noise()
        hexes = self.run("0123456789abcdef", 7, 41)
        return self.pick([
            lambda: f"{self.pick(self.SETTINGS)}{self.pick([' = ', '=', ': '])}{self.pick([hexes, self.number(0, 99999), self.run(LOWER, 3, 9)])}", lambda: f'{self.pick(self.SETTINGS)} = "{self.run(LOWER, 2, 14)}"', lambda: f"commit {hexes}",
            lambda: f"{self.number(1900, 2100)}-{self.number(10, 13)}-{self.number(10, 29)}", lambda: self.number(1, 99999), lambda: f"{self.number(1, 99)}.{self.number(0, 99)}", lambda: f"v{self.number(0, 20)}.{self.number(0, 20)}.{self.number(0, 20)}",
            lambda: f"${self.number(1, 999)},{self.run(DIGITS, 3)}", lambda: f"{self.number(0, 24)}:{self.run(DIGITS, 2)}", lambda: f"@{self.run(LOWER, 3, 9)}", lambda: f"https://{self.run(LOWER, 3, 9)}.org/{self.run(LOWER, 2, 7)}/{self.number(1, 999)}",
            lambda: f"(c) {self.number(1980, 2030)} {self.word()}", lambda: "at " + self.word(), lambda: f"{self.word()} at {self.word()}", lambda: self.pick(self.NAMES + self.HELD_OUT) + " " + self.word(), lambda: f"| {self.word()} | {self.word()} |",
            lambda: f"Version {self.number(1, 9)}.0", lambda: f"ISBN {self.run(DIGITS, 3)}-{self.run(DIGITS, 1)}-{self.run(DIGITS, 4)}-{self.run(DIGITS, 4)}", lambda: self.run(DIGITS, 6, 10),
        ])()

    def text(self, n: int, spans: float = 0.07, decoys: float = 0.06) -> tuple[str, list[int]]:
        """At least n characters and their tags."""
        text, tags = [], []

        def put(part: str, kind: int) -> None:
            text.append(part)
            tags.extend([1 + 2 * kind] + [2 + 2 * kind] * (len(part) - 1) if kind >= 0 and part else [0] * len(part))

        while len(tags) < n:
            u = self.rng.random()
            if u < spans:
                kind = int(self.rng.integers(0, 6))
                for part, k in self.named_secret() if kind >= 4 else [((self.email, self.ip, self.card, self.phone)[kind](), kind)]:
                    put(part, k)
            else:
                put(self.decoy() if u < spans + decoys else self.word(), -1)
            put(self.pick([" ", " ", " ", " ", " ", ", ", ". ", ".\n", "\n"]), -1)
        return "".join(text), tags


def examples(n: int, seed: int, length: int = TRAINING) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags."""
    maker = Maker(seed)
    xs, ys = np.full((n, length), PAD, np.uint8), np.zeros((n, length), np.int64)
    for r in range(n):
        text, tags = maker.text(2 * length, float(maker.rng.choice([0.0, 0.08, 0.15])))
        at = int(maker.rng.integers(0, len(text) - length))
        cut = length if maker.rng.random() < 0.85 else int(maker.rng.integers(20, length))
        xs[r, :cut], ys[r, :cut] = codes(text)[at : at + cut], tags[at : at + cut]
        if ys[r, 0] and ys[r, 0] % 2 == 0:  # the window starts inside a span
            ys[r, 0] -= 1
    return xs, ys


# ---------------------------------------------------------------- model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
    m = {"out": w(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "next": w(TAGS, TAGS, s=0.05), "first": np.zeros(TAGS, np.float32)}
    for side in "lr":
        m[f"x{side}"], m[f"h{side}"] = w(CHARS, 4 * HIDDEN), w(HIDDEN, 4 * HIDDEN)
        m[f"x{side}"][:, HIDDEN : 2 * HIDDEN] += 0.5
    return m


def _run(m: dict[str, np.ndarray], side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) of one direction; what the backward pass needs."""
    t_max, n = x.shape[1], x.shape[0]
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((t_max, n, HIDDEN), np.float32), []
    steps = range(t_max) if side == "l" else range(t_max - 1, -1, -1)
    for t in steps:
        z = m[f"x{side}"][x[:, t]] + h @ m[f"h{side}"]
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * u
        s = np.tanh(c)
        h = o * s
        out[t] = h
        kept.append((t, i, f, o, u, s, *before))
    return out, kept


def _fast_tanh(x: np.ndarray, scratch: np.ndarray) -> None:
    """tanh within 0.024, in place, by a rational function that is 1 at 3; a fifth of the time of tanh."""
    np.clip(x, -3, 3, out=x)
    # x (27 + x^2) / (27 + 9 x^2) = x / 9 (1 + 24 / (3 + x^2))
    np.multiply(x, x, out=scratch)
    scratch += 3
    np.divide(np.float32(24 / 9), scratch, out=scratch)
    scratch += np.float32(1 / 9)
    x *= scratch


def emissions(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(time, batch, TAGS), without what only training needs; all steps share the same few buffers."""
    t_max, n = x.shape[1], len(x)
    # tag by tag in memory, as they are compared
    e = np.empty((t_max, TAGS, n), np.float32)
    e[:] = m["bias"][:, None]
    by_time = np.ascontiguousarray(x.T).astype(np.intp)
    # a sigmoid is half of 1 + tanh of the half: one call serves all gates, and the outer halves are in the weights
    half = np.float32([0.5, 0.5, 0.5, 1.0])[:, None, None]
    # gate by gate in memory: numpy is slow on short runs
    gates = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, HIDDEN).transpose(1, 0, 2))
    z, zz, part = np.empty((4, n, HIDDEN), np.float32), np.empty((4, n, HIDDEN), np.float32), np.empty((TAGS, n), np.float32)
    h, c, u = (np.empty((n, HIDDEN), np.float32) for _ in range(3))
    for side, out in (("l", m["out"][:HIDDEN] * np.float32(0.5)), ("r", m["out"][HIDDEN:] * np.float32(0.5))):
        table, w = gates(m[f"x{side}"]) * half, gates(m[f"h{side}"]) * half * np.float32(0.5)
        h[:], c[:] = 0, 0
        for t in range(t_max) if side == "l" else range(t_max - 1, -1, -1):
            for k in range(4):
                np.take(table[k], by_time[t], axis=0, out=z[k], mode="clip")
                np.matmul(h, w[k], out=zz[k])
            z += zz
            _fast_tanh(z, zz)
            z[:3] += 1
            c *= z[1]
            np.multiply(z[0], z[3], out=u)
            c += u
            c *= 0.5
            np.copyto(h, c)
            _fast_tanh(h, u)
            h *= z[2]
            np.matmul(out.T, h.T, out=part)
            e[t] += part
    return e.transpose(0, 2, 1)


def surely_empty(m: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """True for windows whose best path is proven to hold no span, without a search over all tags.

    The kinds are merged: O, any B and any I, each step and each tag at the best that any kind has. No path scores more
    than the best one over these three, so where that is the path of O alone, it is the best of all.
    """
    b, i = slice(1, None, 2), slice(2, None, 2)
    groups = (slice(0, 1), b, i)
    step = [[float(m["next"][p, q].max()) for q in groups] for p in groups]
    tops = [e[:, :, g.start].copy() for g in groups]
    for k in range(3, TAGS):
        np.maximum(tops[2 - k % 2], e[:, :, k], out=tops[2 - k % 2])
    score = [float(m["first"][g].max()) + top[0] for g, top in zip(groups, tops, strict=True)]
    alone = score[0]
    for t in range(1, len(e)):
        alone = alone + step[0][0] + tops[0][t]
        score = [np.maximum(np.maximum(score[0] + step[0][q], score[1] + step[1][q]), score[2] + step[2][q]) + tops[q][t] for q in range(3)]
    return (score[0] <= alone) & (score[1] < alone) & (score[2] < alone)


def decode(m: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The best tag sequence of each window (batch, time)."""
    tags = np.zeros(x.shape, np.int8)
    if not len(x):
        return tags
    every = emissions(m, x)
    at = np.flatnonzero(~surely_empty(m, every))
    if not len(at):
        return tags
    e = every[:, at]
    score, back = m["first"] + e[0], np.empty((len(e), len(at), TAGS), np.int8)
    for t in range(1, len(e)):
        best, from_ = score[:, :1] + m["next"][0], np.zeros((len(at), TAGS), np.int8)
        for p in range(1, TAGS):
            new = score[:, p : p + 1] + m["next"][p]
            from_ = np.where(new > best, np.int8(p), from_)
            best = np.maximum(best, new)
        back[t], score = from_, best + e[t]
    found = np.empty((len(at), len(e)), np.int8)
    found[:, -1] = score.argmax(1)
    for t in range(len(e) - 1, 0, -1):
        found[:, t - 1] = back[t][np.arange(len(at)), found[:, t]]
    tags[at] = found
    return tags


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def gradients(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of the tags under the CRF, and its gradients."""
    left, kept_l = _run(m, "l", x)
    right, kept_r = _run(m, "r", x)
    h = np.concatenate([left, right], axis=2)
    e = h @ m["out"] + m["bias"]
    t_max, n = e.shape[0], e.shape[1]
    row = np.arange(n)
    a = np.empty_like(e)
    a[0] = m["first"] + e[0]
    for t in range(1, t_max):
        a[t] = _log_sum(a[t - 1][:, :, None] + m["next"], 1) + e[t]
    z = _log_sum(a[-1], 1)
    b = np.zeros((n, TAGS), np.float32)
    d_e, d_next = np.empty_like(e), np.zeros_like(m["next"])
    gold = m["first"][y[:, 0]] + e[0][row, y[:, 0]]
    for t in range(t_max - 1, -1, -1):
        d_e[t] = np.exp(a[t] + b - z[:, None])
        if t:
            ahead = e[t] + b
            d_next += np.exp(a[t - 1][:, :, None] + m["next"] + ahead[:, None, :] - z[:, None, None]).sum(0)
            b = _log_sum(m["next"][None] + ahead[:, None, :], 2)
            gold = gold + m["next"][y[:, t - 1], y[:, t]] + e[t][row, y[:, t]]
            np.add.at(d_next, (y[:, t - 1], y[:, t]), -1)
        d_e[t][row, y[:, t]] -= 1
    g = {"next": d_next / n, "first": d_e[0].sum(0) / n, "bias": d_e.sum((0, 1)) / n, "out": np.einsum("tnh,tnk->hk", h, d_e) / n}
    d_h = d_e @ m["out"].T / n
    for side, kept, part in (("l", kept_l, d_h[:, :, :HIDDEN]), ("r", kept_r, d_h[:, :, HIDDEN:])):
        gx, gh = np.zeros_like(m[f"x{side}"]), np.zeros_like(m[f"h{side}"])
        dh = dc = np.zeros((n, HIDDEN), np.float32)
        for t, i, f, o, u, s, h0, c0 in reversed(kept):
            dh = dh + part[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            np.add.at(gx, x[:, t], dz)
            gh += h0.T @ dz
            dh, dc = dz @ m[f"h{side}"].T, dc * f
        g[f"x{side}"], g[f"h{side}"] = gx, gh
    return float((z - gold).mean()), g


def train(steps: int = 800, batch: int = 48, seed: int = 3, said=lambda text: None) -> dict[str, np.ndarray]:
    """Adam over fresh examples."""
    m = new_model(seed)
    v1, v2 = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        if step % 25 == 1:
            xs, ys = examples(25 * batch, seed * 100_000 + step)
        at = slice((step - 1) % 25 * batch, ((step - 1) % 25 + 1) * batch)
        loss, g = gradients(m, xs[at], ys[at])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1, step / 30) * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for k in m:
            d = g[k] * min(1, 5 / size)
            v1[k] = 0.9 * v1[k] + 0.1 * d
            v2[k] = 0.99 * v2[k] + 0.01 * d * d
            m[k] = (m[k] - rate * (v1[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if step % 50 == 0:
            said(f"{step} {loss:.3f}")
    return m


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in train(said=print).items()})
