"""Cross-validated logistic regression: the fits of all folds and mixes share every pass over the rows.

A pass sums the loss, the gradient and the curvature of every fit; the driver, which holds nothing but these
small matrices, takes a Newton step for the loss with the penalty kept as it is. About ten passes reach the
optimum, whatever the number of fits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cohortlens.operators.blocks import packed, summed

ROUNDS = 100
TOLERANCE = 1e-10


def _step(beta: np.ndarray, slope: np.ndarray, bend: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimum of the quadratic model at ``beta`` plus penalty, by feature-sign search; the intercept (first) is free.

    With the signs of the coefficients that are not zero fixed, the minimum is a linear system. A sign that would turn
    stops the way there at the best crossing; when none turns, the worst of the zeros may move, until none wants to.
    """
    curve = bend + np.diag(np.concatenate(([0.0], np.full(len(beta) - 1, l2))))
    # The model is found' curve found / 2 - pull' found + l1 |found|, up to a constant.
    pull = bend @ beta - slope
    weight = np.full(len(beta), l1)
    weight[0] = 0.0
    slack = 1e-9 * max(l1, 1e-12) + 1e-13

    def goal(v: np.ndarray) -> float:
        return float(0.5 * v @ curve @ v - pull @ v + weight @ np.abs(v))

    found, sign = beta.copy(), np.sign(beta)
    sign[0] = 0.0
    for _ in range(50 * len(beta)):
        on = np.flatnonzero(sign != 0).tolist()
        on = np.array([0, *on])
        end = np.zeros(len(beta))
        end[on] = np.linalg.lstsq(curve[np.ix_(on, on)], (pull - weight * sign)[on], rcond=None)[0]
        turned = [j for j in on[1:] if end[j] * sign[j] <= 0]
        if turned:
            # Where coefficients cross zero on the way, and the end itself.
            ways = [1.0, *{found[j] / (found[j] - end[j]) for j in turned if found[j] != end[j] and found[j] * sign[j] > 0}]
            stops = []
            for w in ways:
                v = found + w * (end - found)
                v[[j for j in turned if abs(v[j]) <= 1e-15 * max(abs(found[j]), abs(end[j]))]] = 0.0
                stops.append(v)
            best = min(stops, key=goal)
            if goal(best) >= goal(found):
                # A coefficient let go of zero without gain goes back.
                stuck = [j for j in turned if found[j] == 0]
                if not stuck:
                    return found
                sign[stuck] = 0.0
                best = found
            found, sign = best, np.sign(best)
            sign[0] = 0.0
            continue
        found = end
        lean = curve @ found - pull
        lean[0] = 0.0
        over = np.where(sign == 0, np.abs(lean) - weight, -np.inf)
        over[0] = -np.inf
        j = int(np.argmax(over))
        if over[j] <= slack:
            return found
        sign[j] = -np.sign(lean[j])
    return found


def fit(
    blocks: DataFrame, features: int, folds: list[int], penalty: float, mixes: list[float], labels: dict[int, tuple[int, int]]
) -> dict[tuple[int, float], np.ndarray]:
    """Coefficients (intercept first) by (fold left out, mix) at the least mean loss plus penalty.

    The penalty is ``penalty`` x (mix x sum of sizes + (1 - mix) / 2 x sum of squares). ``labels`` counts rows and ones
    per fold. With rows of one label only, coefficients are 0 and the intercept is infinite towards that label.
    """
    names = [(f, m) for f in folds for m in mixes]
    width = features + 1
    cells = 1 + width + width * width
    n = np.array([sum(labels[g][0] for g in labels if g != f) for f, _ in names], float)
    ones = np.array([sum(labels[g][1] for g in labels if g != f) for f, _ in names], float)
    beta = np.zeros((len(names), width))
    flat = (ones == 0) | (ones == n)
    beta[flat, 0] = np.where(ones[flat] > 0, np.inf, -np.inf)
    open_ = np.flatnonzero(~flat)
    l1 = np.array([penalty * m for _, m in names])
    l2 = np.array([penalty * (1 - m) for _, m in names])

    def at(fits: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array([names[i][0] for i in fits])

        def part(fold: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.column_stack((np.ones(len(x)), x))
            out = np.zeros((len(fits), cells))
            use = np.flatnonzero(own != fold)
            z = x @ tried[use].T
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            out[use, 0] = (np.logaddexp(0.0, z) - y[:, None] * z).sum(0)
            out[use, 1 : 1 + width] = (p - y[:, None]).T @ x
            for k, i in enumerate(use):
                out[i, 1 + width :] = ((x.T * (p[:, k] * (1.0 - p[:, k]))) @ x).ravel()
            return out.ravel()

        total = summed(blocks, len(fits) * cells, part).reshape(len(fits), cells) / n[fits, None]
        sizes, squares = np.abs(tried[:, 1:]).sum(1), (tried[:, 1:] ** 2).sum(1)
        goal = total[:, 0] + l1[fits] * sizes + 0.5 * l2[fits] * squares
        return goal, total[:, 1 : 1 + width], total[:, 1 + width :].reshape(-1, width, width)

    if len(open_):
        goal, slope, bend = at(open_, beta[open_])
    share = np.ones(len(names))
    for _ in range(ROUNDS):
        if not len(open_):
            break
        ends = np.stack([_step(beta[i], slope[k], bend[k], l1[i], l2[i]) for k, i in enumerate(open_)])
        tried = beta[open_] + share[open_, None] * (ends - beta[open_])
        new_goal, new_slope, new_bend = at(open_, tried)
        # Near the optimum the goal no longer tells steps apart.
        better = new_goal <= goal + 1e-14 * np.abs(goal)
        moved = np.abs(tried - beta[open_]).max(1)
        settled = (goal - new_goal <= TOLERANCE * np.abs(goal)) & better | (moved < 1e-14)
        beta[open_[better]] = tried[better]
        share[open_] = np.where(better, 1.0, share[open_] / 2)
        goal = np.where(better, new_goal, goal)
        slope = np.where(better[:, None], new_slope, slope)
        bend = np.where(better[:, None, None], new_bend, bend)
        open_, goal, slope, bend = open_[~settled], goal[~settled], slope[~settled], bend[~settled]
    return dict(zip(names, beta))


def accuracies(data: DataFrame, features: int, penalty: float, mixes: list[float], folds: int = 10) -> list[float]:
    """Mean accuracy on the fold left out, by mix; ``data`` holds features, label (0 or 1) and ``fold``.

    A fold without rows, or with all of them, is an error.
    """
    blocks = packed(data, fold="fold")

    def count(fold: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not 0 <= fold < folds:
            raise ValueError(f"fold {fold} is not within 0 to {folds - 1}")
        out = np.zeros((folds, 2))
        out[fold] = len(y), y.sum()
        return out.ravel()

    counted = summed(blocks, 2 * folds, count).reshape(folds, 2)
    labels = {f: (int(a), int(b)) for f, (a, b) in enumerate(counted)}
    for f in range(folds):
        if not labels[f][0] or labels[f][0] == counted[:, 0].sum():
            raise ValueError(f"fold {f} leaves no rows to fit or to judge")
    found = fit(blocks, features, list(range(folds)), penalty, mixes, labels)

    def right(fold: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, len(mixes)))
        for k, m in enumerate(mixes):
            beta = found[fold, m]
            out[fold, k] = ((beta[0] + x @ beta[1:] > 0) == y).sum()
        return out.ravel()

    hits = summed(blocks, folds * len(mixes), right).reshape(folds, len(mixes))
    return (hits / counted[:, :1]).mean(0).tolist()
