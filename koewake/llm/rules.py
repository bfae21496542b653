"""Ordered rule lists by incremental reduced-error pruning, and their export to SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v <= self.threshold if self.at_most else v > self.threshold

    def sql(self, prefix: str) -> str:
        return f"{prefix}{self.feature} {'<=' if self.at_most else '>'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for c in rule:
        ok &= c.holds(x, names)
    return ok


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> Rule:
    """Adds the condition of the highest information gain until no negative is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base = np.log2(p0 / (p0 + n0))
        best, best_gain = None, 1e-9
        for j, name in enumerate(names):
            v, t = x[inside, j], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(t)[cut], np.cumsum(~t)[cut]
            for at_most, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best_gain = gain[k]
                    best = Condition(name, at_most, float(round((v[cut[k]] + v[cut[k] + 1]) / 2, 4)))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
        if not y[inside].any():
            break
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str], cost: float) -> tuple[Rule, float]:
    """The prefix of the rule that is worth most on rows it wasn't grown on, a wrong row costing ``cost`` right ones; its error."""
    best, best_worth, best_error = rule, -np.inf, 1.0
    for k in range(len(rule), 0, -1):
        c = _covers(rule[:k], x, names)
        p, n = int(y[c].sum()), int((~y[c]).sum())
        worth = p - cost * n
        if worth >= best_worth:
            best, best_worth, best_error = rule[:k], worth, n / (p + n) if p + n else 1.0
    return best, float(best_error)


def induce(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 0, most_rules: int = 16, most_conditions: int = 5, error: float = 0.2, cost: float = 12.0, least: int = 15) -> list[Rule]:
    """Rules for the true rows of ``y``, in order; what none of them covers is false.

    It ends at a rule that is wrong too often, or right for fewer than ``least`` of the rows it is pruned on.
    """
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, float), np.asarray(y, bool)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while y[left].any() and len(rules) < most_rules:
        at = np.flatnonzero(left)
        rng.shuffle(at)
        grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        if not y[grow].any() or not len(prune):
            break
        rule = _grow(x[grow], y[grow], names, most_conditions)
        if not rule:
            break
        rule, wrong = _prune(rule, x[prune], y[prune], names, cost)
        if wrong > error or (_covers(rule, x[prune], names) & y[prune]).sum() < least:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, names)
    return rules


def predict(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for r in rules:
        out |= _covers(r, np.asarray(x, float), names)
    return out


def to_sql(rules: list[Rule], prefix: str = "") -> str:
    """A CASE expression that is true where a rule holds."""
    if not rules:
        return "false"
    return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql(prefix) for c in r)} THEN true" for r in rules) + " ELSE false END"
