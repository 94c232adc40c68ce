"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy on fixed windows of characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
#: 0 is outside; 2k+1 begins kind k, 2k+2 continues it.
TAGS = 2 * len(KINDS) + 1
WINDOW = 64
#: What the net sees of a character; one beyond ASCII is a letter or another mark.
INPUTS = {c: n for n, c in enumerate("@.+-_() %/\n,:;")}
DIGIT, LOWER, UPPER, LETTER, MARK, PAD = (len(INPUTS) + i for i in range(6))
VOCABULARY = PAD + 1
HIDDEN = 16
NEVER = -1e4


def code(c: str) -> int:
    if c in INPUTS:
        return INPUTS[c]
    if "0" <= c <= "9":
        return DIGIT
    if "a" <= c <= "z":
        return LOWER
    if "A" <= c <= "Z":
        return UPPER
    return LETTER if c.isalpha() else MARK


ASCII_CODES = np.array([code(chr(i)) for i in range(128)], np.int64)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = ASCII_CODES[np.minimum(points, 127)]
    for i in np.flatnonzero(points > 127).tolist():
        out[i] = code(text[i])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def transitions_allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: a kind is continued only after itself."""
    allowed = np.zeros((TAGS, TAGS))
    for a in range(TAGS):
        for b in range(2, TAGS, 2):
            if a not in (b, b - 1):
                allowed[a, b] = NEVER
    return allowed


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (VOCABULARY, 4 * HIDDEN))
            w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"x{d}"][:, HIDDEN : 2 * HIDDEN] += 1.0  # forget gates start open
        w["out"], w["bias"], w["step"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
        return cls(w)

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (windows, characters, HIDDEN) of one direction; keep gets what the way back needs."""
        n, length = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.empty((n, length, HIDDEN))
        given, own = self.weights[f"x{d}"], self.weights[f"h{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = given[x[:, t]] + h @ own
            gates, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i * g
            shape = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, shape))
            h, c = o * shape, new
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(x, "f"), self.run(x, "b")], axis=2) @ self.weights["out"] + self.weights["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        emit, step = self.scores(x), self.weights["step"] + transitions_allowed()
        n, length, _ = emit.shape
        best, back = emit[:, 0].copy(), np.zeros((n, length, TAGS), np.int8)
        for t in range(1, length):
            way = best[:, :, None] + step[None]
            back[:, t] = way.argmax(axis=1)
            best = way.max(axis=1) + emit[:, t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def loss_and_slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, (n, length) = self.weights, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self.run(x, d, kept[d]) for d in "fb"], axis=2)
        emit = hidden @ w["out"] + w["bias"]
        step = w["step"] + transitions_allowed()
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, length):
            alpha[:, t] = log_sum(alpha[:, t - 1][:, :, None] + step[None], 1) + emit[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = log_sum(step[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = log_sum(alpha[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(length)[None]
        right = emit[rows, places, y].sum() + step[y[:, :-1], y[:, 1:]].sum()
        by_tag = np.exp(alpha + beta - whole[:, None, None])
        by_tag[rows, places, y] -= 1
        both = np.exp(alpha[:, :-1, :, None] + step + (emit + beta)[:, 1:, None, :] - whole[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(both, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        slopes = {"out": np.einsum("nth,ntk->hk", hidden, by_tag), "bias": by_tag.sum(axis=(0, 1)), "step": both}
        to_hidden = by_tag @ w["out"].T
        for d, part in (("f", to_hidden[:, :, :HIDDEN]), ("b", to_hidden[:, :, HIDDEN:])):
            sx, sh = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"])
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, h, c, i, f, o, g, shape in reversed(kept[d]):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - shape**2)
                z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * shape * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                np.add.at(sx, x[:, t], z)
                sh += h.T @ z
                dh, dc = z @ w[f"h{d}"].T, dc * f
            slopes[f"x{d}"], slopes[f"h{d}"] = sx, sh
        return float((whole.sum() - right) / n), {k: v / n for k, v in slopes.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 0) -> float:
        """Adam over ``steps`` batches; the last loss a window."""
        rng, loss = np.random.default_rng(seed), 0.0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for n in range(1, steps + 1):
            chosen = rng.integers(0, len(x), batch)
            loss, slopes = self.loss_and_slopes(x[chosen], y[chosen])
            speed = rate * min(1.0, 3 * (1 - n / (steps + 1)))
            for k, g in slopes.items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= speed * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
        return loss


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
