"""Elastic net of one target on a bounded matrix: coordinate descent along a path of penalties.

The objective is |y - X w|^2 / (2 n) + a r |w|_1 + a (1 - r) |w|^2 / 2, with penalty a and
share r of the absolute values. Descent runs on the features in use, whose products with
one another are taken once; all others are checked at once against the optimum's condition.
Up to DIRECT features in use it goes from one set of signs to the next, solving each at once.
"""

from __future__ import annotations

import numpy as np

#: Features in use up to which a set of signs is solved as one system.
DIRECT = 256


class Descent:
    """Coordinate descent on centred data; fit() starts from the last penalty's weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l1_ratio: float):
        self.x, self.y, self.ratio, self.n = x, y, l1_ratio, len(y)
        self.toward = x.T @ y
        self.square = (x**2).sum(0)
        self.weights = np.zeros(x.shape[1])
        self.used: list[int] = []
        self.products = np.zeros((0, 0))

    def _admit(self, features: np.ndarray) -> None:
        self.used += features.tolist()
        own = self.x[:, self.used]
        self.products = own.T @ own

    def _solve(self, w: np.ndarray, toward: np.ndarray, square: np.ndarray, l1: float, l2: float, steps: int = 1000) -> bool:
        """Bring w to the optimum of the features in use, if steps suffice; no step raises the objective.

        The optimum of the signs that w has is one linear system. Where it turns a sign, w goes
        towards it up to the first zero, which stays; else features pulled from zero are descended.
        """
        for _ in range(steps):
            on = np.flatnonzero(w)
            if len(on):
                sign = np.sign(w[on])
                try:
                    goal = np.linalg.solve(self.products[np.ix_(on, on)] + l2 * np.eye(len(on)), toward[on] - l1 * sign)
                except np.linalg.LinAlgError:  # equal features and hardly a penalty
                    return False
                turned = goal * sign <= 0
                if turned.any():
                    share = np.where(turned, w[on] / np.where(turned, w[on] - goal, 1.0), np.inf)
                    w[on] += share.min() * (goal - w[on])
                    w[on[share == share.min()]] = 0.0
                    continue
                w[on] = goal
            gradient = toward - self.products[:, on] @ w[on]
            late = np.flatnonzero((w == 0) & (np.abs(gradient) > l1 * (1 + 1e-9)) & (square > 0))
            if not len(late):
                return True
            for k in late[np.argsort(-np.abs(gradient[late]), kind="stable")]:
                if (excess := abs(gradient[k]) - l1) > 0:
                    w[k] = np.sign(gradient[k]) * excess / (square[k] + l2)
                    gradient -= w[k] * self.products[:, k]
        return False

    def fit(self, penalty: float, tolerance: float = 1e-7, sweeps: int = 2000) -> np.ndarray:
        l1, l2 = self.n * penalty * self.ratio, self.n * penalty * (1 - self.ratio)
        scale = np.sqrt(max((self.y**2).sum(), 1e-300))
        while True:
            w, toward, square = self.weights[self.used], self.toward[self.used], self.square[self.used]
            if len(w) > DIRECT or not self._solve(w, toward, square, l1, l2):
                gradient = toward - self.products @ w
                for _ in range(sweeps):
                    largest = 0.0
                    for k in range(len(w)):
                        pull = gradient[k] + square[k] * w[k]
                        new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (square[k] + l2) if square[k] > 0 else 0.0
                        if (step := new - w[k]) != 0.0:
                            w[k] = new
                            gradient -= step * self.products[:, k]
                            largest = max(largest, abs(step) * np.sqrt(square[k]))
                    if largest <= tolerance * scale:
                        break
            self.weights[self.used] = w
            pull = np.abs(self.x.T @ (self.y - self.x[:, self.used] @ w))
            pull[self.used] = 0
            late = np.flatnonzero(pull > l1 * (1 + 1e-6))
            if not len(late):
                return self.weights.copy()
            self._admit(late[np.argsort(-pull[late], kind="stable")[:64]])


def path(x: np.ndarray, y: np.ndarray, penalties: np.ndarray, l1_ratio: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """(weights, intercept) for each of the falling penalties."""
    centre, mean = x.mean(0), y.mean()
    descent = Descent(x - centre, y - mean, l1_ratio)
    return [(w := descent.fit(p), float(mean - centre @ w)) for p in penalties]


def penalty_grid(x: np.ndarray, y: np.ndarray, l1_ratio: float = 0.5, n_penalties: int = 12, least: float = 1e-3) -> np.ndarray:
    """Falling penalties on a log scale, from the least that leaves every weight at zero to that share of it."""
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / (len(y) * l1_ratio)
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * least, n_penalties)


def cross_validated(x: np.ndarray, y: np.ndarray, l1_ratio: float = 0.5, n_penalties: int = 12, folds: int = 3) -> tuple[float, np.ndarray, float]:
    """(penalty, weights, intercept) at the least mean error over consecutive folds, fitted to all rows."""
    penalties = penalty_grid(x, y, l1_ratio, n_penalties)
    errors = np.zeros(n_penalties)
    for held in np.array_split(np.arange(len(y)), folds):
        rest = np.setdiff1d(np.arange(len(y)), held)
        for k, (w, b) in enumerate(path(x[rest], y[rest], penalties, l1_ratio)):
            errors[k] += ((y[held] - x[held] @ w - b) ** 2).mean() / folds
    best = int(errors.argmin())
    w, b = path(x, y, penalties[: best + 1], l1_ratio)[-1]
    return float(penalties[best]), w, b
