"""Character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding and storage."""

from __future__ import annotations

import numpy as np

PAD = 0


class Alphabet:
    """Characters as small numbers: ASCII one by one (digits as one), others by class."""

    def __init__(self):
        self.table = np.zeros(0x3000, np.int16)
        for i in range(len(self.table)):
            c = chr(i)
            if c.isdigit():
                n = 1
            elif 33 <= i < 127:
                n = i - 33 + 8
            elif c in "\n\r\u0085":
                n = 2
            elif c.isspace():
                n = 3
            elif c.isupper():
                n = 4
            elif c.isalpha():
                n = 5
            else:
                n = 6
            self.table[i] = n
        self.table[0] = 6
        self.size = 8 + 127 - 33

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = codes >= len(self.table)
        if not wide.any():
            return self.table[codes]
        full = (codes >= 0xFF10) & (codes <= 0xFF19)
        at = codes == 0xFF20
        return np.where(wide, np.where(full, 1, np.where(at, ord("@") - 33 + 8, 7)), self.table[np.where(wide, 0, codes)]).astype(np.int16)


class Tagger:
    """Gates stand in the order i, f, o, g; sigmoid(z) is tanh(z / 2) / 2 + 1 / 2, so one tanh serves all four."""

    def __init__(self, size: int, tags: int, hidden: int, seed: int = 1):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {f"x{d}": g(size, 4 * hidden) for d in "fb"} | {f"h{d}": g(hidden, 4 * hidden) for d in "fb"}
        for d in "fb":
            self.p["x" + d][:, hidden : 2 * hidden] += 1  # remember at first
        self.p |= {"o": g(2 * hidden, tags), "ob": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32)}
        self._halved: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _weights(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Weights with the sigmoid gates halved."""
        scale = np.ones(4 * self.hidden, np.float32)
        scale[: 3 * self.hidden] = 0.5
        return self.p["x" + d] * scale, self.p["h" + d] * scale

    def _run(self, X: np.ndarray, d: str, keep: bool):
        B, L = X.shape
        H = self.hidden
        if keep:
            Wx, Wh = self._weights(d)
        else:
            if d not in self._halved:
                self._halved[d] = self._weights(d)
            Wx, Wh = self._halved[d]
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        out, saved = np.empty((L, B, H), np.float32), []
        XT = np.ascontiguousarray(X.T)
        z, x = np.empty((B, 4 * H), np.float32), np.empty((B, 4 * H), np.float32)
        for t in range(L) if d == "f" else range(L - 1, -1, -1):
            if keep:
                z = np.empty((B, 4 * H), np.float32)
            np.matmul(h, Wh, out=z)
            np.take(Wx, XT[t], 0, out=x, mode="clip")
            z += x
            np.tanh(z, out=z)
            s = z[:, : 3 * H]
            s *= 0.5
            s += 0.5
            i, f, o, g = z[:, :H], z[:, H : 2 * H], z[:, 2 * H : 3 * H], z[:, 3 * H :]
            before = (h, c) if keep else None
            c = f * c
            c += i * g
            tc = np.tanh(c)
            h = np.multiply(o, tc, out=out[t])
            if keep:
                saved.append((t, z, tc, *before))
        return out, saved

    def scores(self, X: np.ndarray) -> np.ndarray:
        """Emission scores (L, B, tags)."""
        H = self.hidden
        e = self._run(X, "f", False)[0] @ self.p["o"][:H]
        e += self._run(X, "b", False)[0] @ self.p["o"][H:]
        e += self.p["ob"]
        return e

    def decode(self, X: np.ndarray) -> np.ndarray:
        """Best tags (B, L) by Viterbi; the way back is found from the forward scores."""
        e = self.scores(X)
        L, B, K = e.shape
        T = self.p["t"]
        a = np.empty((L, K, B), np.float32)
        a[0] = e[0].T
        for t in range(1, L):
            np.add((a[t - 1][:, None, :] + T[:, :, None]).max(0), e[t].T, out=a[t])
        tags = np.empty((B, L), np.int8)
        y = a[-1].argmax(0)
        tags[:, -1] = y
        for t in range(L - 2, -1, -1):
            y = (a[t] + T[:, y]).argmax(0)
            tags[:, t] = y
        return tags

    def step(self, X: np.ndarray, Y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and gradients."""
        B, L = X.shape
        H = self.hidden
        f, sf = self._run(X, "f", True)
        b, sb = self._run(X, "b", True)
        P = self.p
        e = (f @ P["o"][:H] + b @ P["o"][H:] + P["ob"]).astype(np.float64)
        T = P["t"].astype(np.float64)
        top = e.max(2, keepdims=True)
        E, M = np.exp(e - top), np.exp(T)
        alpha, beta, norm = np.empty_like(E), np.ones_like(E), np.empty((L, B))
        for t in range(L):
            alpha[t] = E[t] if t == 0 else (alpha[t - 1] @ M) * E[t]
            norm[t] = alpha[t].sum(1)
            alpha[t] /= norm[t][:, None]
        for t in range(L - 2, -1, -1):
            beta[t] = (beta[t + 1] * E[t + 1]) @ M.T / norm[t + 1][:, None]
        logz = np.log(norm).sum(0) + top[:, :, 0].sum(0)
        Yt = Y.T
        gold = np.take_along_axis(e, Yt[:, :, None], 2)[:, :, 0].sum(0) + T[Yt[:-1], Yt[1:]].sum(0)
        de = alpha * beta
        after = (E * beta / norm[:, :, None])[1:].reshape(-1, self.tags)
        dT = M * (alpha[:-1].reshape(-1, self.tags).T @ after)
        np.subtract.at(dT, (Yt[:-1], Yt[1:]), 1)
        np.put_along_axis(de, Yt[:, :, None], np.take_along_axis(de, Yt[:, :, None], 2) - 1, 2)
        de = (de / B).astype(np.float32)
        flat = de.reshape(-1, self.tags)
        grad = {"t": (dT / B).astype(np.float32), "ob": flat.sum(0), "o": np.concatenate((f.reshape(-1, H).T @ flat, b.reshape(-1, H).T @ flat))}
        for d, saved in (("f", sf), ("b", sb)):
            W = P["o"][:H] if d == "f" else P["o"][H:]
            dhs = de @ W.T
            U = P["h" + d].T.copy()
            dh, dc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
            dzs, hs = np.empty((L, B, 4 * H), np.float32), np.empty((L, B, H), np.float32)
            for t, z, tc, h0, c0 in reversed(saved):
                i, fg, o, g = z[:, :H], z[:, H : 2 * H], z[:, 2 * H : 3 * H], z[:, 3 * H :]
                dh = dh + dhs[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = dzs[t]
                dz[:, :H], dz[:, H : 2 * H], dz[:, 2 * H : 3 * H], dz[:, 3 * H :] = dc * g * i * (1 - i), dc * c0 * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - g * g)
                hs[t] = h0
                dh, dc = dz @ U, dc * fg
            flat = dzs.reshape(-1, 4 * H)
            grad["h" + d] = hs.reshape(-1, H).T @ flat
            # sums by character: sorted, so that one reduction serves each
            codes = X.T.reshape(-1)
            order = np.argsort(codes, kind="stable")
            at = np.flatnonzero(np.diff(codes[order], prepend=-1))
            gx = np.zeros_like(P["x" + d])
            gx[codes[order][at]] = np.add.reduceat(flat[order], at, 0)
            grad["x" + d] = gx
        return float((logz - gold).mean()), grad

    def save(self, path: str, **more) -> None:
        np.savez_compressed(path, hidden=self.hidden, tags=self.tags, **{"w_" + k: v.astype(np.float16) for k, v in self.p.items()}, **more)

    @classmethod
    def load(cls, path: str) -> Tagger:
        z = np.load(path)
        out = cls(1, int(z["tags"]), int(z["hidden"]))
        out.p = {k[2:]: z[k].astype(np.float32) for k in z.files if k.startswith("w_")}
        return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], clip: float = 5.0):
        self.p, self.clip, self.n = p, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, self.clip / (norm + 1e-9))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)
