"""A small character-level bidirectional LSTM with a linear-chain CRF, in numpy."""

from __future__ import annotations

import numpy as np

NEVER = -1e4


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags: 0 outside; 1 + 2k begins and 2 + 2k continues a span of kind k."""

    def __init__(self, symbols: int, kinds: int, embedding: int = 12, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        tags = 1 + 2 * kinds
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": draw(symbols, embedding) * np.float32(np.sqrt(symbols) * 0.3), "out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p[f"wx{d}"], self.p[f"wh{d}"] = draw(embedding, 4 * hidden), draw(hidden, 4 * hidden)
            self.p[f"b{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"b{d}"][hidden : 2 * hidden] = 1.0
        # A span continues only what has begun.
        self.banned = np.zeros((tags, tags), np.float32)
        self.banned_first = np.zeros(tags, np.float32)
        for k in range(kinds):
            inside = 2 + 2 * k
            self.banned[[t for t in range(tags) if t not in (inside, inside - 1)], inside] = NEVER
            self.banned_first[inside] = NEVER
        self.hidden, self.tags = hidden, tags

    def _run(self, x, d, keep):
        """LSTM over time-major inputs (T, N, E); returns states and what backward needs."""
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        c = np.zeros_like(h)
        gates = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        out, saved, n = np.empty((len(x), *h.shape), np.float32), [], self.hidden
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = gates[t] + h @ self.p[f"wh{d}"]
            s = _sigmoid(np.concatenate([g[:, : 2 * n], g[:, 3 * n :]], axis=1))
            i, f, o, u = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 2 * n : 3 * n])
            before, hb = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                saved.append((t, i, f, o, u, before, tc, hb))
        return out, saved

    def emissions(self, codes, keep=False):
        """(T, N, tags) scores of time-major codes (T, N)."""
        x = self.p["emb"][codes]
        hf, sf = self._run(x, "f", keep)
        hb, sb = self._run(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["bias"], (x, h, sf, sb)

    def decode(self, codes):
        """Best tags (T, N) and posteriors (T, N, tags) of time-major codes."""
        e, _ = self.emissions(codes)
        return self.best_path(e), self.marginals(e)

    def best_path(self, e):
        """Tags (T, N) of the best path through emissions (T, N, tags)."""
        trans, first = self.p["trans"] + self.banned, self.p["first"] + self.banned_first
        score, back = first + e[0], []
        for t in range(1, len(e)):
            step = score[:, :, None] + trans
            back.append(step.argmax(axis=1))
            score = step.max(axis=1) + e[t]
        tags = np.empty(e.shape[:2], np.int64)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t - 1][rows, tags[t]]
        return tags

    def _forward_backward(self, e):
        trans, first = self.p["trans"] + self.banned, self.p["first"] + self.banned_first
        T = len(e)
        alpha, beta = np.empty(e.shape), np.zeros(e.shape)
        alpha[0] = first + e[0]
        for t in range(1, T):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(T - 2, -1, -1):
            beta[t] = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _logsumexp(alpha[-1], 1)

    def marginals(self, e):
        """(T, N, tags) posterior probability of each tag."""
        alpha, beta, z = self._forward_backward(e)
        return np.exp(alpha + beta - z[None, :, None])

    def gradients(self, codes, gold):
        """Mean loss per window and the gradient of every parameter."""
        T, n = codes.shape
        e, (x, h, sf, sb) = self.emissions(codes, keep=True)
        alpha, beta, z = self._forward_backward(e)
        trans, first = self.p["trans"] + self.banned, self.p["first"] + self.banned_first
        post = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        path = first[gold[0]] + e[np.arange(T)[:, None], rows, gold].sum(axis=0) + trans[gold[:-1], gold[1:]].sum(axis=0)
        loss = float((z - path).mean())
        de = post.copy()
        de[np.arange(T)[:, None], rows, gold] -= 1
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, T):
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            grad["trans"] += pair.sum(axis=0).astype(np.float32)
        np.add.at(grad["trans"], (gold[:-1].ravel(), gold[1:].ravel()), -1)
        grad["first"] = de[0].sum(axis=0)
        de = de.astype(np.float32)
        flat = de.reshape(-1, self.tags)
        grad["out"], grad["bias"] = h.reshape(-1, h.shape[2]).T @ flat, flat.sum(axis=0)
        dh = de @ self.p["out"].T
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, dh[:, :, : self.hidden]), ("b", sb, dh[:, :, self.hidden :])):
            nh, nc = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
            dgates = np.empty((T, n, 4 * self.hidden), np.float32)
            states = np.empty((T, n, self.hidden), np.float32)
            for t, i, f, o, u, before, tc, hb in reversed(saved):
                g = part[t] + nh
                dc = g * o * (1 - tc * tc) + nc
                dgates[t] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - u * u), g * tc * o * (1 - o)], axis=1)
                nh, nc = dgates[t] @ self.p[f"wh{d}"].T, dc * f
                states[t] = hb
            flat = dgates.reshape(-1, 4 * self.hidden)
            grad[f"wx{d}"] = x.reshape(-1, x.shape[2]).T @ flat
            grad[f"wh{d}"] = states.reshape(-1, self.hidden).T @ flat
            grad[f"b{d}"] = flat.sum(axis=0)
            dx += dgates @ self.p[f"wx{d}"].T
        np.add.at(grad["emb"], codes.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss, {k: v / n for k, v in grad.items()}

    def fit(self, codes, gold, epochs: int = 14, batch: int = 64, rate: float = 0.03, seed: int = 11):
        """Adam over shuffled windows (N, T); the order depends on the seed alone."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(codes)), 0.0
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                loss, grad = self.gradients(codes[pick].T, gold[pick].T)
                total += loss * len(pick)
                step += 1
                lr = rate * 0.5 ** (3 * epoch / epochs)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                for k in self.p:
                    g = grad[k] * clip
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(order)))
        return losses
