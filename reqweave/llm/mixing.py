"""Mixing sources to target weights by iterative proportional fitting (raking).

Token weights are raked to the marginals of each dimension. A document is sampled with a probability, so a cell can't
get more tokens than it has: raking respects that bound, and where the wanted share of all tokens is more than the targets allow,
the largest share that meets them is kept instead. What is sampled is therefore calibrated, not only the weights.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import columns

OTHER = "__other__"
ROUNDS, TOLERANCE = 400, 1e-9
#: Halvings of the search for the largest share of tokens that meets the targets.
STEPS = 14
#: Categories of a dimension whose target is a temperature, at most.
MOST = 1000


def tokens_of(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """Targets: for each dimension the wanted share of each category; ``keep``: the share of all tokens to keep.

    A number in place of the shares is a temperature: each category that occurs gets its own share to that power, scaled.
    Categories that are not named (and null) are one, ``__other__``, which keeps the share it has.
    """

    targets: dict[str, dict[str, float] | float]
    keep: float = 0.6
    seed: int = 17
    dims: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Calibrated:
    """Of each cell its weight (the share of what stays) and probability; the share of tokens kept, and how far a marginal is off at most."""

    weights: np.ndarray
    chance: np.ndarray
    keep: float
    gap: float


def _factor(x: np.ndarray, most: np.ndarray, target: float) -> float:
    """f such that min(most, f * x) adds up to the target, or as much as can be."""
    some = x > 0
    x, most = x[some], most[some]
    if not len(x):
        return 1.0
    order = np.argsort(most / x)
    x, most = x[order], most[order]
    held = np.r_[0, np.cumsum(most)]  # the first ones are at their bound
    free = x[::-1].cumsum()[::-1]
    f = (target - held[:-1]) / free
    fits = np.flatnonzero(f <= most / x)
    return max(float(f[fits[0]]), 0.0) if len(fits) else float((most / x)[-1])


def rake(tokens: np.ndarray, marginals: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Weights of the cells that have the marginals (shares of 1), none above ``most``: the bounded form of raking.

    Each axis in turn is scaled until its sums are the marginals, so odds between cells that are not at their bound stay.
    After ``ROUNDS`` rounds it is what it is: ``gap`` tells how far off.
    """
    most = np.full(tokens.shape, np.inf) if most is None else most
    x = tokens / max(tokens.sum(), 1)
    for _ in range(ROUNDS):
        for axis, target in enumerate(marginals):
            for i, want in enumerate(target):
                at = tuple(i if a == axis else slice(None) for a in range(x.ndim))
                x[at] *= _factor(x[at].ravel(), most[at].ravel(), want)
        if gap(np.minimum(x, most), marginals) < TOLERANCE:
            break
    return np.minimum(x, most)


def gap(weights: np.ndarray, marginals: list[np.ndarray]) -> float:
    """The largest difference between the weights' sums along an axis and its marginals."""
    sums = (weights.sum(axis=tuple(a for a in range(weights.ndim) if a != axis)) for axis in range(len(marginals)))
    return max((float(np.abs(s - m).max()) for s, m in zip(sums, marginals)), default=0.0)


def calibrate(tokens: np.ndarray, marginals: list[np.ndarray], keep: float) -> Calibrated:
    """Probabilities that keep ``keep`` of all tokens, or the largest share that meets the marginals."""
    total = max(tokens.sum(), 1)
    share = tokens / total

    def fit(k: float) -> Calibrated:
        w = rake(tokens, marginals, share / k)
        chance = np.divide(w * k, share, out=np.zeros_like(w), where=share > 0)
        return Calibrated(w, np.minimum(1, chance), k, gap(w, marginals))

    for axis, target in enumerate(marginals):  # no category can give more than it has
        have = share.sum(axis=tuple(a for a in range(share.ndim) if a != axis))
        keep = min([keep, *(have[target > 0] / target[target > 0])])
    if keep <= 0:
        return Calibrated(np.zeros_like(share), np.zeros_like(share), 0.0, 0.0)
    best = fit(keep)
    if best.gap < 1e-6:
        return best
    lo, hi, best = 0.0, keep, None
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        tried = fit(mid)
        lo, hi, best = (mid, hi, tried) if tried.gap < 1e-6 else (lo, mid, best)
    return best or fit(keep)


def _shares(target: dict[str, float] | float, names: list[str], have: np.ndarray) -> np.ndarray:
    """Target shares of the categories that occur, ``__other__`` (the last) with the share it has."""
    share = have / max(have.sum(), 1)
    if isinstance(target, dict):
        out = np.array([target.get(n, 0.0) for n in names[:-1]] + [0.0])
    else:
        out = np.r_[share[:-1] ** target, 0.0]
    out[have == 0] = 0
    if out.sum() > 0:
        out *= (1 - share[-1]) / out.sum()
    out[-1] = share[-1] if out.sum() > 0 else min(1.0, have.sum())
    return out


def mix(
    docs: DataFrame,
    plan: Mix,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    draw: Column | None = None,
    prefix: str = "mix_",
) -> DataFrame:
    """``docs`` with the columns mix_cell, mix_tokens, mix_weight, mix_probability and mix_sampled added.

    A document is sampled if a hash of its id, text and the seed, as a number from 0 to 1, is
    below its cell's probability, so repeated rows share their fate and runs repeat. The expected tokens of what
    is sampled meet every target; where the plan's ``keep`` allows none of that, less is kept, and where targets contradict each
    other on this table (a category that occurs only with another one), the nearest found is taken, with a warning.
    The driver gets one row for each cell of named categories: the product of the targets' sizes bounds
    it, whatever the data. Null texts have no tokens; their cell still has a probability. An
    empty table stays empty. Columns of ``docs`` that have the names of added ones are replaced; another ``prefix``
    leaves them. ``tokens`` and ``draw`` (a 64-bit hash) can be given where they are known, so that the text is not needed.
    """
    added = [f"{prefix}{x}" for x in ("cell", "tokens", "weight", "probability", "sampled")]
    docs = docs.drop(*added)
    exprs = {d: plan.dims.get(d, F.col(f"`{d}`")) for d in plan.targets}
    names: dict[str, list[str]] = {}
    for d, t in plan.targets.items():
        named = sorted(t) if isinstance(t, dict) else sorted(r[0] for r in docs.select(exprs[d]).distinct().limit(MOST + 1).collect() if r[0] is not None)
        if len(named) > MOST:
            raise ValueError(f"{d} has more than {MOST} categories: name the wanted ones")
        names[d] = [*(n for n in named if n != OTHER), OTHER]
    shape = [len(n) for n in names.values()]
    cell, n_cells = F.lit(0), 1
    for d, n in names.items():
        index = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(n) for x in (c, i)]), exprs[d].cast("string"))
        cell, n_cells = cell * len(n) + F.coalesce(index, F.lit(len(n) - 1)), n_cells * len(n)
    counted = tokens_of(F.col(text_col)) if tokens is None else tokens
    sums = docs.groupBy(cell.alias("c")).agg(F.sum(counted).alias("t")).collect()
    found = np.zeros(n_cells)
    found[[r["c"] for r in sums]] = [r["t"] or 0 for r in sums]
    found = found.reshape(shape)
    have = [found.sum(axis=tuple(a for a in range(found.ndim) if a != i)) for i in range(found.ndim)]
    marginals = [_shares(plan.targets[d], names[d], h) for d, h in zip(names, have)]
    fitted = calibrate(found, marginals, plan.keep)
    if fitted.gap > 1e-6:
        warnings.warn(f"the targets contradict each other on this table: a share is off by {fitted.gap:.3g}", stacklevel=2)
    labels = [json.dumps([n[i] for n, i in zip(names.values(), at)], ensure_ascii=False) for at in np.ndindex(*shape)]
    here = {r["c"] for r in sums}
    table = [(c, labels[c], float(w), float(p)) for c, (w, p) in enumerate(zip(fitted.weights.ravel(), fitted.chance.ravel())) if c in here]
    cell_no, label, n_tokens, weight, chance = "__c", *added[:4]
    known = docs.sparkSession.createDataFrame(table, f"{cell_no} int, `{label}` string, `{weight}` double, `{chance}` double")
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(plan.seed)) if draw is None else F.xxhash64(draw, F.lit(plan.seed))
    drawn = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    rows = docs.select(F.struct(*columns(docs)).alias("row"), cell.alias(cell_no), counted.alias(n_tokens), drawn.alias("__drawn"))
    out = rows.join(F.broadcast(known), cell_no)
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        label,
        n_tokens,
        weight,
        chance,
        (F.col("__drawn") < F.col(chance)).alias(added[4]),
    )
