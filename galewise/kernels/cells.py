"""Recurrent and convolutional cells of sequence nowcasts, forward only. Frames are [rows, cols]; hidden states [channels, rows, cols]."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Same-size convolution of [in, rows, cols] by [out, in, k, k]."""
    k = w.shape[2]
    padded = np.pad(x, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    views = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(1, 2))
    return np.einsum("irckl,oikl->orc", views, w, optimize=True) + b[:, None, None]


class Weights:
    """Seeded random weights: those that were trained are not public, so that shapes and equations can be tested."""

    def __init__(self, seed: int = 0, scale: float = 0.1) -> None:
        self.rng, self.scale = np.random.default_rng(seed), scale

    def __call__(self, *shape: int) -> np.ndarray:
        return self.rng.normal(0, self.scale, shape)


class ConvCell:
    """kind gru: z, r = sigmoid(conv[x, h]), n = tanh(conv[x, r h]), h = (1 - z) h + z n. lstm: gates i, f, o, g in one convolution.
    rnn: h = tanh(conv[x, h])."""

    def __init__(self, kind: str, inputs: int, hidden: int, k: int, make: Weights) -> None:
        gates = {"gru": 2, "lstm": 4, "rnn": 1}[kind]
        self.kind, self.hidden = kind, hidden
        self.w, self.b = make(gates * hidden, inputs + hidden, k, k), np.zeros(gates * hidden)
        if kind == "gru":
            self.wn, self.bn = make(hidden, inputs + hidden, k, k), np.zeros(hidden)

    def start(self, shape) -> tuple:
        zero = np.zeros((self.hidden, *shape))
        return (zero, zero) if self.kind == "lstm" else (zero,)

    def step(self, x: np.ndarray, state: tuple) -> tuple:
        h, n = state[0], self.hidden
        gates = conv(np.concatenate([x, h]), self.w, self.b)
        if self.kind == "rnn":
            return (np.tanh(gates),)
        if self.kind == "gru":
            z, r = sigmoid(gates[:n]), sigmoid(gates[n:])
            new = np.tanh(conv(np.concatenate([x, r * h]), self.wn, self.bn))
            return ((1 - z) * h + z * new,)
        i, f, o, g = sigmoid(gates[:n]), sigmoid(gates[n : 2 * n]), sigmoid(gates[2 * n : 3 * n]), np.tanh(gates[3 * n :])
        c = f * state[1] + i * g
        return (o * np.tanh(c), c)


class ConvSeq2Seq:
    """Stacked encoder; the decoder starts from the last layer's state, emits a frame by a 1 x 1 convolution and feeds it back by a 3 x 3 one."""

    def __init__(self, kind: str, hidden: int = 8, k: int = 3, layers: int = 2, seed: int = 0) -> None:
        make = Weights(seed)
        self.encoder = [ConvCell(kind, 1 if i == 0 else hidden, hidden, k, make) for i in range(layers)]
        self.decoder = ConvCell(kind, hidden, hidden, k, make)
        self.out, self.out_b = make(1, hidden, 1, 1), np.zeros(1)
        self.back, self.back_b = make(hidden, 1, 3, 3), np.zeros(hidden)

    def predict(self, frames: np.ndarray, steps: int) -> np.ndarray:
        states = [cell.start(frames.shape[1:]) for cell in self.encoder]
        for frame in frames:
            x = frame[None]
            for k, cell in enumerate(self.encoder):
                states[k] = cell.step(x, states[k])
                x = states[k][0]
        state, out = states[-1], []
        for _ in range(steps):
            frame = conv(state[0], self.out, self.out_b)
            out.append(frame[0])
            state = self.decoder.step(conv(frame, self.back, self.back_b), state)
        return np.array(out)


class PlainCell:
    def __init__(self, kind: str, inputs: int, hidden: int, make: Weights) -> None:
        gates = {"gru": 3, "lstm": 4, "rnn": 1}[kind]
        self.kind, self.hidden = kind, hidden
        self.wx, self.wh, self.b = make(gates * hidden, inputs), make(gates * hidden, hidden), np.zeros(gates * hidden)

    def step(self, x: np.ndarray, state: tuple) -> tuple:
        h, n = state[0], self.hidden
        a, u = self.wx @ x + self.b, self.wh @ h
        if self.kind == "rnn":
            return (np.tanh(a + u),)
        if self.kind == "gru":
            r, z = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
            return ((1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h,)
        g = a + u
        c = sigmoid(g[n : 2 * n]) * state[1] + sigmoid(g[:n]) * np.tanh(g[2 * n : 3 * n])
        return (sigmoid(g[3 * n :]) * np.tanh(c), c)


class Seq2Seq:
    """Encoder over flat frames; each output is projected to pixels and back to the next input."""

    def __init__(self, kind: str, pixels: int, hidden: int = 16, seed: int = 0) -> None:
        make = Weights(seed)
        self.encoder, self.decoder = PlainCell(kind, pixels, hidden, make), PlainCell(kind, hidden, hidden, make)
        self.out, self.back, self.hidden = make(pixels, hidden), make(hidden, pixels), hidden

    def predict(self, frames: np.ndarray, steps: int) -> np.ndarray:
        state = (np.zeros(self.hidden), np.zeros(self.hidden)) if self.encoder.kind == "lstm" else (np.zeros(self.hidden),)
        for frame in frames.reshape(len(frames), -1):
            state = self.encoder.step(frame, state)
        x, out = state[0], []
        for _ in range(steps):
            state = self.decoder.step(x, state)
            frame = self.out @ state[0]
            out.append(frame.reshape(frames.shape[1:]))
            x = self.back @ frame
        return np.array(out)


def model(name: str, pixels: int, seed: int = 0):
    """By name: ConvGRU, ConvLSTM, ConvRNN, GRU, LSTM, RNN, or Persistence."""
    kind = name.removeprefix("Conv").lower()
    if name == "Persistence":
        return Persistence()
    if kind not in ("gru", "lstm", "rnn"):
        raise ValueError(f"no such model: {name}")
    return ConvSeq2Seq(kind, seed=seed) if name.startswith("Conv") else Seq2Seq(kind, pixels, seed=seed)


class Persistence:
    """The last frame again and again: a nowcast that needs no weights."""

    def predict(self, frames: np.ndarray, steps: int) -> np.ndarray:
        return np.repeat(frames[-1:], steps, axis=0)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected regions, 0 outside; numbered in row order of their first pixel."""
    labels, n = np.zeros(mask.shape, dtype=np.int64), 0
    for r, c in zip(*np.nonzero(mask), strict=True):
        if labels[r, c]:
            continue
        n += 1
        stack = [(r, c)]
        labels[r, c] = n
        while stack:
            y, x = stack.pop()
            for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not labels[v, u]:
                    labels[v, u] = n
                    stack.append((v, u))
    return labels


def rotated(frame: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre by nearest pixels, zero outside."""
    rows, cols = frame.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:rows, :cols] - np.array([(rows - 1) / 2, (cols - 1) / 2])[:, None, None]
    sy, sx = np.rint(np.cos(t) * y - np.sin(t) * x + (rows - 1) / 2).astype(int), np.rint(np.sin(t) * y + np.cos(t) * x + (cols - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < rows) & (sx >= 0) & (sx < cols)
    out = np.zeros_like(frame)
    out[inside] = frame[sy[inside], sx[inside]]
    return out


def bilinear(frame: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values at fractional places, zero outside."""
    padded = np.pad(frame.astype(float), 1)
    r, c = np.clip(rows + 1, 0, padded.shape[0] - 1.001), np.clip(cols + 1, 0, padded.shape[1] - 1.001)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    a, b = r - r0, c - c0
    return padded[r0, c0] * (1 - a) * (1 - b) + padded[r0 + 1, c0] * a * (1 - b) + padded[r0, c0 + 1] * (1 - a) * b + padded[r0 + 1, c0 + 1] * a * b
