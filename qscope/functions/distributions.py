"""Declared shapes of columns, drawn with a seeded generator."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Distribution:
    kind: str
    values: tuple

    def draw(self, rng: random.Random):
        v = self.values
        if self.kind == "discrete":
            return rng.choice(v)
        if self.kind == "uniform":
            return rng.uniform(*v)
        if self.kind == "normal":
            return rng.gauss(*v)
        if self.kind == "binomial":
            return sum(rng.random() < v[1] for _ in range(int(v[0])))
        if self.kind == "poisson":
            limit, k, p = math.exp(-v[0]), 0, rng.random()
            while p > limit:
                k, p = k + 1, p * rng.random()
            return k
        weights = [1 / (i + 1) ** v[1] for i in range(int(v[0]))]
        return rng.choices(range(1, len(weights) + 1), weights)[0]


NAMES = {"uniform": ("uniform", 2), "normal": ("normal", 2), "gauss": ("normal", 2), "norm": ("normal", 2), "binom": ("binomial", 2), "binomial": ("binomial", 2), "poisson": ("poisson", 1), "zipf": ("zipf", 2)}


def parse(column: str, text: str) -> Distribution:
    """`uniform(0, 10)`, `zipf(100, 1.2)`, or discrete values: `[a, 'b, c', 3]`."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        parts = [a or b for a, b in re.findall(r"'([^']*)'|([^,\s][^,]*)", text[1:-1])]
        if not parts:
            raise ValueError(f"column {column}: no values in {text}")
        return Distribution("discrete", tuple(_number(p.strip()) for p in parts))
    m = re.fullmatch(r"(\w+)\((.*)\)", text)
    if not m or m[1].lower() not in NAMES:
        raise ValueError(f"column {column}: unknown distribution {text}")
    kind, n = NAMES[m[1].lower()]
    try:
        values = tuple(float(x) for x in m[2].split(","))
    except ValueError as e:
        raise ValueError(f"column {column}: {m[2]!r} aren't numbers") from e
    if len(values) != n:
        raise ValueError(f"column {column}: {kind} takes {n} numbers")
    return Distribution(kind, values)


def _number(s: str):
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s
