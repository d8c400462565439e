"""Training and evaluation by turns, for a model whose steps are given."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Evaluation:
    number: int
    steps: int
    score: float
    best: float
    since: int  # evaluations since the best improved


def alternating(train: Callable[[], None], evaluate: Callable[[int], float], seconds: float, patience: int, least: float = 0.1, keep: Callable[[int], None] | None = None, clock: Callable[[], float] = time.monotonic) -> list[Evaluation]:
    """Training steps for ``seconds``, then an evaluation, until ``patience`` evaluations
    in a row don't beat the best score by ``least``; the model of each that does is kept.

    At least one step is made between two evaluations.  ``evaluate`` and ``keep`` get the
    evaluation's number, from 1.
    """
    out: list[Evaluation] = []
    best, since, steps = float("-inf"), 0, 0
    while not out or since < patience:
        until = clock() + seconds
        while True:
            train()
            steps += 1
            if clock() >= until:
                break
        number = len(out) + 1
        score = evaluate(number)
        if not out or score >= best + least:
            best, since = score, 0
            if keep:
                keep(number)
        else:
            since += 1
        out.append(Evaluation(number, steps, score, best, since))
    return out
