"""A character-level bidirectional LSTM with a CRF over its tags, in numpy: training, emissions and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = np.float32(-1e4)


def tags_of(kinds: tuple[str, ...]) -> list[str]:
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]


def allowed(tags: list[str]) -> np.ndarray:
    """Penalties of transitions: an inside tag only follows its own kind."""
    out = np.zeros((len(tags), len(tags)), dtype=np.float32)
    for i, a in enumerate(tags):
        for j, b in enumerate(tags):
            if b[0] == "I" and a[1:] != b[1:]:
                out[i, j] = NEVER
    return out


@dataclass
class Net:
    """Both directions are stacked on the first axis: ``inputs`` (2, symbols, 4h), ``state`` (2, h, 4h).

    Gates lie as input, forget, output, candidate. Sigmoids are written as tanh of half, with the half in the weights.
    """

    inputs: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    @staticmethod
    def new(symbols: int, hidden: int, tags: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        inputs = draw(2, symbols, 4 * hidden, scale=0.3)
        inputs[:, :, hidden : 2 * hidden] += 0.5  # remember at first
        return Net(inputs, draw(2, hidden, 4 * hidden, scale=0.15), draw(2 * hidden, tags, scale=0.2), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.out, self.bias, self.moves, self.begin]

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Emissions (rows, steps, tags) of symbol rows (rows, steps); with ``keep`` what the way back needs."""
        rows, steps = x.shape
        h4 = self.state.shape[2]
        n = h4 // 4
        both = np.stack([x, x[:, ::-1]])
        h = np.zeros((2, rows, n), np.float32)
        c = np.zeros((2, rows, n), np.float32)
        hs = np.empty((steps, 2, rows, n), np.float32)
        held = []
        for t in range(steps):
            g = np.matmul(h, self.state)
            g[0] += self.inputs[0][both[0, :, t]]
            g[1] += self.inputs[1][both[1, :, t]]
            np.tanh(g, out=g)
            gates = g[:, :, : 3 * n] * np.float32(0.5) + np.float32(0.5)
            before = c
            c = gates[:, :, n : 2 * n] * c + gates[:, :, :n] * g[:, :, 3 * n :]
            tc = np.tanh(c)
            after = gates[:, :, 2 * n :] * tc
            if keep:
                held.append((h, before, gates, g[:, :, 3 * n :], tc))
            h = after
            hs[t] = h
        both_ways = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)  # steps, rows, 2n
        return (both_ways @ self.out + self.bias).transpose(1, 0, 2), [both, both_ways, held]

    def decode(self, emissions: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """The best tags (rows, steps) by Viterbi."""
        rows, steps, tags = emissions.shape
        moves = self.moves + penalty
        score = emissions[:, 0] + self.begin
        score[:, penalty[0] < 0] += NEVER  # no row begins inside a span
        back = np.empty((steps, rows, tags), np.int8)
        for t in range(1, steps):
            total = score[:, :, None] + moves
            back[t] = total.argmax(axis=1)
            score = total.max(axis=1) + emissions[:, t]
        best = np.empty((rows, steps), np.int8)
        best[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            best[:, t - 1] = back[t][np.arange(rows), best[:, t]]
        return best


def gradients(net: Net, x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags ``y`` per row, and its gradients in the order of ``parameters``.

    The forward and backward sums are scaled to one at each step, so they need no logarithms; a step's greatest emission
    is taken out before it is raised to a power.
    """
    rows, steps = x.shape
    e, (both, both_ways, held) = net.run(x, keep=True)
    tags = e.shape[2]
    moves = np.exp(net.moves + penalty)
    top = e.max(axis=2)
    weight = np.exp(e - top[:, :, None]).transpose(1, 0, 2)  # steps, rows, tags
    start = net.begin.max()
    alpha, beta, scale = np.empty_like(weight), np.ones_like(weight), np.empty((steps, rows, 1), weight.dtype)
    for t in range(steps):
        a = (alpha[t - 1] @ moves if t else np.exp(net.begin - start)) * weight[t]
        scale[t] = a.sum(axis=1, keepdims=True)
        np.divide(a, scale[t], out=alpha[t])
    back = weight / scale
    for t in range(steps - 2, -1, -1):
        np.matmul(beta[t + 1] * back[t + 1], moves.T, out=beta[t])
    z = np.log(scale).sum(axis=(0, 2)) + top.sum(axis=1) + start
    r, c = np.arange(rows)[:, None], np.arange(steps)
    gold = net.begin[y[:, 0]] + e[r, c, y].sum(axis=1) + (net.moves + penalty)[y[:, :-1], y[:, 1:]].sum(axis=1)
    d_e = alpha * beta
    d_e[c[:, None], np.arange(rows), y.T] -= 1
    d_begin = d_e[0].sum(axis=0)
    expected = alpha[:-1].reshape(-1, tags).T @ (beta[1:] * back[1:]).reshape(-1, tags) * moves
    seen = np.bincount((y[:, :-1] * tags + y[:, 1:]).ravel(), minlength=tags * tags).reshape(tags, tags)
    d_moves = (expected - seen).astype(net.moves.dtype)
    flat = both_ways.reshape(-1, both_ways.shape[2])
    d_out, d_bias = flat.T @ d_e.reshape(-1, tags), d_e.sum(axis=(0, 1))
    d_h = d_e @ net.out.T
    n = net.state.shape[1]
    d_h = np.stack([d_h[:, :, :n], d_h[::-1, :, n:]], axis=1)  # steps, 2, rows, n
    carry_h, carry_c = np.zeros((2, rows, n), d_h.dtype), np.zeros((2, rows, n), d_h.dtype)
    turned = net.state.transpose(0, 2, 1)
    d_gates = np.empty((steps, 2, rows, 4 * n), d_h.dtype)
    for t in range(steps - 1, -1, -1):
        _, before, gates, cand, tc = held[t]
        i, f, o = gates[:, :, :n], gates[:, :, n : 2 * n], gates[:, :, 2 * n :]
        dh = d_h[t] + carry_h
        dc = carry_c + dh * o * (1 - tc**2)
        dg = d_gates[t]
        dg[:, :, :n] = dc * cand
        dg[:, :, n : 2 * n] = dc * before
        dg[:, :, 2 * n : 3 * n] = dh * tc
        dg[:, :, : 3 * n] *= 2 * gates * (1 - gates)
        dg[:, :, 3 * n :] = dc * i * (1 - cand**2)
        carry_c = dc * f
        carry_h = np.matmul(dg, turned)
    states = np.stack([k[0] for k in held])  # steps, 2, rows, n
    d_in, d_state = np.zeros_like(net.inputs), np.zeros_like(net.state)
    for way in (0, 1):
        d_state[way] = states[:, way].reshape(-1, n).T @ d_gates[:, way].reshape(rows * steps, -1)
        one = np.zeros((rows * steps, net.inputs.shape[1]), d_h.dtype)
        one[np.arange(rows * steps), both[way].T.ravel()] = 1
        d_in[way] = one.T @ d_gates[:, way].reshape(rows * steps, -1)
    return float((z - gold).mean()), [g / rows for g in (d_in, d_state, d_out, d_bias, d_moves, d_begin)]


def fit(x: np.ndarray, y: np.ndarray, symbols: int, tags: list[str], hidden: int = 16, steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Net:
    """Train by Adam on shuffled batches; the same input gives the same net."""
    net, penalty, rng = Net.new(symbols, hidden, len(tags), seed), allowed(tags), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = rng.permutation(len(x)).tolist()
        chosen, order = order[:batch], order[batch:]
        _, grads = gradients(net, x[chosen], y[chosen], penalty)
        scale = min(1.0, 5.0 / (1e-9 + sum(float((g**2).sum()) for g in grads) ** 0.5))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return net
