"""Generation as a game: at each step a mask of options is shown, an action picks one, and a finished query is rewarded
for the number of its rows.

No threads: the environment keeps the decisions made so far and walks again from the start at each step. Values
(names, literals) are drawn from a seeded source and stay the same in each walk.
"""

from __future__ import annotations

import random

from . import ast as A
from .engine import Engine
from .generator import Chooser, Walker
from .grammar import GRAMMAR

ACTIONS = sorted({(f, o) for f, options in GRAMMAR.items() for o in options} | {("items", "list")})
WORST, BEST, FINISHED = -5.0, 5.0, 6.0


class _Need(Exception):
    pass


class _Steps(Chooser):
    def __init__(self, made: list[str], seed: int):
        self.made, self.at, self.random = made, 0, random.Random(seed)
        self.open: list[str] = []
        self.function = ""

    def option(self, stack: list[str], before: str, options: list[str]) -> str:
        if len(options) == 1:
            return options[0]
        if self.at == len(self.made):
            self.open, self.function = options, stack[-1]
            raise _Need
        self.at += 1
        return self.made[self.at - 1]

    def value(self, what: str, options: list):
        return options[self.random.randrange(len(options))]

    def number(self, low: int, high: int) -> int:
        return self.random.randint(low, high)


def range_reward(rows: int | None, low: int, high: int) -> float:
    """BEST inside [low, high], minus the greater relative error outside, WORST if the query failed."""
    if rows is None:
        return WORST
    if low <= rows <= high:
        return BEST
    error = max(abs(rows - b) / max(b, 1) for b in (low, high))
    return max(-error, WORST)


class ConstraintEnv:
    """reset() and step(action) in the manner of a gym environment; ``mask`` shows which of ACTIONS are open."""

    def __init__(self, engine: Engine, low: int = 20, high: int = 30, max_steps: int = 300, seed: int = 0):
        self.engine, self.low, self.high, self.max_steps, self.seed = engine, low, high, max_steps, seed
        self.reset()

    def reset(self) -> list[bool]:
        self.made: list[str] = []
        self.query: A.Query | None = None
        self._walk()
        return self.mask

    def _walk(self) -> None:
        steps = _Steps(self.made, self.seed)
        self.mask = [False] * len(ACTIONS)
        try:
            self.query = Walker(self.engine.schema, steps).query()[0]
        except _Need:
            self.mask = [f == steps.function and o in steps.open for f, o in ACTIONS]

    def rows(self) -> int | None:
        """Rows of the finished query, counted by Spark; None if it fails on the data."""
        try:
            return self.engine.sql(self.query).count()
        except Exception:  # whatever the query does to the data
            return None

    def estimated_rows(self) -> int:
        """The optimizer's own estimate, without running anything."""
        plan = self.engine.sql(self.query)._jdf.queryExecution().optimizedPlan()
        count = plan.stats().rowCount()
        return int(str(count.get())) if count.isDefined() else -1

    def step(self, action: int) -> tuple[list[bool] | None, float, bool, bool, dict]:
        """(mask, reward, terminated, truncated, info)."""
        if len(self.made) >= self.max_steps:
            return None, -1.0, False, True, {"error": "generation was cut off"}
        if not self.mask[action]:
            return None, -1.0, False, True, {"error": "this action isn't open"}
        self.made.append(ACTIONS[action][1])
        self._walk()
        if self.query is None:
            return self.mask, 0.0, False, False, {}
        return self.mask, FINISHED + range_reward(self.rows(), self.low, self.high), True, False, {"query": self.query}
