"""A linear-chain conditional random field in numpy, over padded batches of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def batches(lens: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Sequences in groups of like length, of about ``most`` padded places, one sequence at least."""
    order = np.argsort(lens, kind="stable")
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k - start + 1) * lens[order[k]] > most:
            yield order[start:k]
            start = k


def padded(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows flat[starts[i]:starts[i]+lens[i]] as (sequence, place, ...), and the mask of real places."""
    place = np.arange(int(lens.max()) if len(lens) else 0)
    mask = place[None, :] < lens[:, None]
    at = np.minimum(starts[:, None] + place[None, :], max(len(flat) - 1, 0))
    return flat[at], mask


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z by sequence, label marginals by place, and summed transition marginals. ``e``:
    (sequence, place, label) scores. Sequences have at least one place."""
    b, t, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        step = _sum_exp(alpha[:, i - 1, :, None] + trans[None], 1) + e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    z = _sum_exp(alpha[:, -1], 1)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        after = e[:, i + 1] + beta[:, i + 1]
        step = _sum_exp(trans[None] + after[:, None, :], 2)
        on = mask[:, i + 1]
        beta[:, i] = np.where(on[:, None], step, 0.0)
        if on.any():
            pairs += np.exp(alpha[on, i, :, None] + trans[None] + after[on][:, None, :] - z[on, None, None]).sum(0)
    return z, np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None], pairs


def _chain(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward scores of one long sequence of (place, label) scores, in about sqrt(places) runs that
    are worked through side by side: first for each label before a run, which tells how runs
    follow one another, then with what really comes before them."""
    t, k = e.shape
    width = max(1, int(np.sqrt(t)))
    n = -(-t // width)
    runs = np.zeros((n * width, k))
    runs[:t] = e
    runs = runs.reshape(n, width, k)

    def forward(start: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        now = runs[:, 0] + start
        for i in range(width):
            if i:
                now = _sum_exp(now[:, :, None] + trans[None], 1) + runs[:, i]
            if out is not None:
                out[:, i] = now
        return now

    through = np.stack([forward(np.broadcast_to(trans[s], (n, k))) for s in range(k)], axis=1)
    start = np.zeros((n, k))
    last = forward(start)[0]
    for i in range(1, n):
        start[i] = _sum_exp(last[:, None] + trans, 0)
        last = _sum_exp(last[:, None] + through[i], 0)
    out = np.empty_like(runs)
    forward(start, out)
    return out.reshape(n * width, k)[:t]


def long_marginals(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label marginals by place of one sequence, in a number of steps that grows with the square
    root of its length."""
    both = _chain(e, trans) + _chain(e[::-1], trans.T)[::-1] - e
    return np.exp(both - _sum_exp(both, 1)[:, None])


def viterbi(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels by sequence and place. Of equal paths the one with lower labels wins."""
    b, t, k = e.shape
    back = np.zeros((b, t, k), np.int16)
    best = e[:, 0]
    for i in range(1, t):
        via = best[:, :, None] + trans[None]
        back[:, i] = via.argmax(1)
        step = via.max(1) + e[:, i]
        on = mask[:, i, None]
        best = np.where(on, step, best)
        back[:, i] = np.where(on, back[:, i], np.arange(k)[None])
    out = np.zeros((b, t), np.int64)
    out[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i, None], 1)[:, 0]
    return out


def adam(grad_of, params: list[np.ndarray], rounds: int, rate: float = 0.05) -> None:
    """Minimise in place; ``grad_of`` returns the gradients for the current values."""
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for n in range(1, rounds + 1):
        for p, g, a, b in zip(params, grad_of(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)
