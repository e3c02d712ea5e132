"""Two scoring functions for windows, given weights by name: an encoder and a recurrent head.

Plain numpy on a batch of windows; Spark spreads the batches
(:mod:`stridelake.operators.scoring`).  ``weights`` maps names to arrays; a dense
layer is ``<name>.w`` (out x in) and ``<name>.b``, a norm ``<name>.gain`` and ``<name>.bias``.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

Weights = Mapping[str, np.ndarray]
NORM_EPS = 1e-12


def _dense(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.w"].T + w[f"{name}.b"]


def _norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    spread = np.sqrt((centred**2).mean(axis=-1, keepdims=True) + NORM_EPS)
    return centred / spread * w[f"{name}.gain"] + w[f"{name}.bias"]


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by formula 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * (1 + erf(x / np.sqrt(2.0))) / 2


def _attention(x: np.ndarray, w: Weights, heads: int) -> np.ndarray:
    batch, steps, hidden = x.shape
    q, k, v = (
        _dense(x, w, name).reshape(batch, steps, heads, hidden // heads).swapaxes(1, 2) for name in ("query", "key", "value")
    )
    logits = q @ k.swapaxes(2, 3) / np.sqrt(hidden // heads)
    shares = np.exp(logits - logits.max(axis=-1, keepdims=True))
    shares /= shares.sum(axis=-1, keepdims=True)
    return (shares @ v).swapaxes(1, 2).reshape(batch, steps, hidden)


def encode(x: np.ndarray, w: Weights, heads: int = 4, layers: int = 4, norm_first: bool = True) -> np.ndarray:
    """Windows (B, W, F) to embeddings (B, W, H).

    One block is applied ``layers`` times; its first residual adds to the
    attention's output, not to the attention's input.
    """
    h = _dense(x, w, "input")
    if norm_first:
        h = _norm(h, w, "input_norm")
    h = _norm(h + w["position"][: x.shape[1]], w, "input_norm")
    for _ in range(layers):
        h = _attention(h, w, heads)
        h = _norm(h + _dense(h, w, "mix"), w, "norm1")
        h = _norm(h + _dense(_gelu(_dense(h, w, "wide")), w, "narrow"), w, "norm2")
    return h


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 + np.tanh(x / 2)) / 2


def _recur(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """One gated recurrent layer; rows of the weights are reset, update and candidate gates."""
    size = w[f"{name}.state.w"].shape[1]
    from_input = _dense(x, w, f"{name}.input")
    h = np.zeros((x.shape[0], size), dtype=x.dtype)
    out = np.empty((*x.shape[:2], size), dtype=x.dtype)
    for step in range(x.shape[1]):
        i, s = from_input[:, step], _dense(h, w, f"{name}.state")
        reset = _sigmoid(i[:, :size] + s[:, :size])
        update = _sigmoid(i[:, size : 2 * size] + s[:, size : 2 * size])
        candidate = np.tanh(i[:, 2 * size :] + reset * s[:, 2 * size :])
        h = (1 - update) * candidate + update * h
        out[:, step] = h
    return out


def classify(x: np.ndarray, w: Weights, layers: int = 3) -> np.ndarray:
    """Embeddings (B, W, H) to class scores (B, classes): recurrent layers, last step, dense."""
    for i in range(layers):
        x = _recur(x, w, f"rnn{i}")
    return _dense(x[:, -1], w, "out")


def random_weights(
    seed: int, features: int = 6, hidden: int = 72, wide: int = 144, steps: int = 120,
    recurrent: tuple[int, ...] = (20, 20, 10), classes: int = 6, scale: float = 0.1,
) -> dict[str, np.ndarray]:
    """A weight bundle of the right shapes for trials; real ones come from training elsewhere."""
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype("float32")

    w = {"position": draw(steps, hidden)}
    dense = [("input", features, hidden), ("mix", hidden, hidden), ("wide", hidden, wide), ("narrow", wide, hidden)]
    dense += [(name, hidden, hidden) for name in ("query", "key", "value")]
    sizes = [hidden, *recurrent]
    for i, (a, b) in enumerate(zip(sizes, recurrent)):
        dense += [(f"rnn{i}.input", a, 3 * b), (f"rnn{i}.state", b, 3 * b)]
    for name, a, b in [*dense, ("out", sizes[-1], classes)]:
        w[f"{name}.w"], w[f"{name}.b"] = draw(b, a), draw(b)
    for name in ("input_norm", "norm1", "norm2"):
        w[f"{name}.gain"], w[f"{name}.bias"] = np.ones(hidden, "float32"), np.zeros(hidden, "float32")
    return w
