"""Choice of base bits: a closed-form size model, and walks along one entropy-ordered list of positions.

All walks look at prefixes of that list, so the profile of distinct counts (one job) is all they need; they
run on the driver over as many numbers as a row has bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidConfig
from ..layout import bits_needed


@dataclass(frozen=True)
class SizeModel:
    """Sizes in bits of n rows (condensed ones included) of ``bits`` bits and ``features`` columns."""

    n: int
    bits: int
    features: int

    def breakdown(self, j: int, k: int) -> dict:
        ids = bits_needed(k) if k else 0
        out = {"j": j, "k": k, "size_bases": k * j, "size_deviations": self.n * (self.bits - j), "size_ids": self.n * ids, "size_params": 16 * self.features + 16 + self.bits}
        return out | {"total_size": sum(v for c, v in out.items() if c.startswith("size_"))}

    def size(self, j: int, k: int) -> int:
        return self.breakdown(j, k)["total_size"]


@dataclass
class Walk:
    """The outcome: the chosen prefix length and the breakdowns of all prefixes looked at."""

    best: int
    steps: list[dict]


def _single(model: SizeModel, profile: list[int], start: int, patience: int, after_failure: bool, steps: list[dict]) -> int:
    best, size, fails = start, model.size(start, profile[start]), 0
    for j in range(start + 1, model.bits + 1):
        steps.append(model.breakdown(j, profile[j]))
        if steps[-1]["total_size"] < size:
            best, size, fails = j, steps[-1]["total_size"], 0
            if not after_failure and fails >= patience:
                break
        else:
            fails += 1
            if fails >= patience:
                break
    return best


def naive(model: SizeModel, profile: list[int], constants: int, patience: int) -> Walk:
    """One bit after another; stop after ``patience`` steps in a row that aren't strictly smaller."""
    steps = [model.breakdown(constants, profile[constants])]
    return Walk(_single(model, profile, constants, patience, False, steps), steps)


def threshold(model: SizeModel, profile: list[int], entropies: list[float], most: float, patience: int) -> Walk:
    """All positions of at most an entropy at once, whatever that costs, then one bit after another."""
    start = sum(h <= most for h in entropies)
    steps = [model.breakdown(start, profile[start])]
    return Walk(_single(model, profile, start, patience, False, steps), steps)


def clusters(entropies: list[float], decay: float) -> list[int]:
    """Sizes of runs of sorted entropies: each spans at most a width, which shrinks from the whole range by ``decay``."""
    if not 0 < decay < 1:
        raise InvalidConfig("a decay between 0 and 1")
    if not entropies:
        return []
    width = entropies[-1] - entropies[0]
    if width <= 0:
        return [len(entropies)]
    out, i = [], 0
    while i < len(entropies):
        width *= decay
        j = i
        while j < len(entropies) and entropies[j] - entropies[i] <= width:
            j += 1
        out.append(j - i)
        i = j
    return out


def adaptive(model: SizeModel, profile: list[int], entropies: list[float], constants: int, decay: float, patience: int) -> Walk:
    """Whole clusters while each makes it smaller, then one bit after another from the last that did."""
    best, steps = constants, [model.breakdown(constants, profile[constants])]
    end = constants
    for n in clusters(entropies[constants:], decay):
        end += n
        steps.append(model.breakdown(end, profile[end]))
        if steps[-1]["total_size"] >= model.size(best, profile[best]):
            break
        best = end
    return Walk(_single(model, profile, best, patience, True, steps), steps)


def all_bits(model: SizeModel, profile: list[int], batches: int = 1) -> Walk:
    """The whole row as base, looked at in so many batches."""
    if batches < 1:
        raise InvalidConfig("one batch at least")
    ends = sorted({-(-model.bits * (i + 1) // batches) for i in range(batches)})
    return Walk(model.bits, [model.breakdown(j, profile[j]) for j in ends])


def enforce_minimum(profile: list[int], best: int, least: int | None) -> int:
    """The first longer prefix with at least so many bases, whatever its size; all bits if there is none."""
    if least is None:
        return best
    if least < 1:
        raise InvalidConfig("one base at least")
    if profile[best] >= least:
        return best
    return next((j for j in range(best + 1, len(profile)) if profile[j] >= least), len(profile) - 1)
