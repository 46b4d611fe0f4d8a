"""Follow-the-regularised-leader (proximal) for sparse rows, several classes, elastic net.

Runs on the driver over the bounded sample its caller states.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    def __init__(self, classes: int, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((classes, size))
        self.n = np.zeros((classes, size))

    def weights(self, at=slice(None)) -> np.ndarray:
        """The regularised leader: zero where the gradients' sum stays under l1."""
        z = self.z[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[:, at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """``gradient`` at the features ``at`` (distinct), where the weights were ``w``."""
        n = self.n[:, at]
        more = n + gradient**2
        self.z[:, at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = more


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
