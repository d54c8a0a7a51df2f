"""Decisions over the table of runs: what to read, what to merge and where to."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..schema import STAGING, Bound, Compaction, Options, Run


#: What a row takes in a sort besides its key and value, and what the rows of a batch's file should take at most.
ROW_BYTES, SORT_BYTES = 64, 64 << 20


@dataclass(frozen=True)
class Task:
    """Merge ``upper`` runs with the overlapping ``lower`` ones into level ``to``."""

    upper: tuple[int, ...]
    lower: tuple[int, ...]
    to: int
    bottom: bool


def reaches(run: Run, lower: Bound, upper: Bound) -> bool:
    """Whether the run can hold a key of the range."""
    if lower.key is not None and (run.last_key < lower.key or run.last_key == lower.key and not lower.inclusive):
        return False
    return upper.key is None or not (run.first_key > upper.key or run.first_key == upper.key and not upper.inclusive)


def disjoint(runs: list[Run]) -> bool:
    """Whether no two runs' key ranges meet."""
    by = sorted(runs, key=lambda r: r.first_key)
    return all(a.last_key < b.first_key for a, b in zip(by, by[1:]))


def settled(runs: list[Run]) -> bool:
    """Whether the runs can be read without looking for the newest version of each key."""
    return all(r.unique for r in runs) and disjoint(runs)


def level_targets(real: list[int], policy: Compaction) -> list[int]:
    """The size each level should have, from the last level upwards; 0 where data should skip it."""
    out = [0] * len(real)
    out[-1] = max(real[-1], policy.base_bytes)
    for i in reversed(range(len(real) - 1)):
        out[i] = out[i + 1] // policy.multiplier if out[i + 1] > policy.base_bytes else 0
    return out


def base_level(targets: list[int]) -> int:
    return 1 + next(i for i, t in enumerate(targets) if t > 0)


def met(runs: list[Run], others: list[Run]) -> tuple[int, ...]:
    """The ids of ``others`` that meet the whole key range of ``runs``."""
    first, last = min(r.first_key for r in runs), max(r.last_key for r in runs)
    return tuple(r.run_id for r in others if r.first_key <= last and first <= r.last_key)


def next_task(runs: list[Run], policy: Compaction) -> Task | None:
    """What the leveled policy compacts now, if anything."""
    at = {level: [r for r in runs if r.level == level] for level in range(policy.max_levels + 1)}
    real = [sum(r.bytes for r in at[level]) for level in range(1, policy.max_levels + 1)]
    targets = level_targets(real, policy)
    if len(at[0]) >= policy.l0_trigger:
        to = base_level(targets)
        return Task(tuple(r.run_id for r in at[0]), met(at[0], at[to]), to, to == policy.max_levels)
    pressure = {i + 1: size / target if target else math.inf if size else math.nan for i, (size, target) in enumerate(zip(real, targets))}
    full = {level: p for level, p in pressure.items() if p > 1 and level < policy.max_levels}
    if not full:
        return None
    level = max(full, key=full.get)
    oldest = min(at[level], key=lambda r: r.run_id)
    return Task((oldest.run_id,), met([oldest], at[level + 1]), level + 1, level + 1 == policy.max_levels)


def pending_flush(runs: list[Run], options: Options) -> bool:
    """Whether the committed batches are as many bytes, or as many files, as a flush waits for."""
    staged = [r.bytes for r in runs if r.level == STAGING]
    return len(staged) >= options.staging_files or sum(staged) >= options.staging_limit * options.target_run_bytes > 0


def batch_files(rows: int, size: int, least: int) -> int:
    """Into how many files a batch of ``size`` bytes of keys and values goes. Each is sorted by one task."""
    return max(least, math.ceil((size + rows * ROW_BYTES) / SORT_BYTES))


def run_files(old: list[Run], options: Options) -> int:
    """Into how many files a merge goes: by the bytes of runs, or by rows where these take few bytes each."""
    return max(1, math.ceil(sum(r.bytes for r in old) / options.target_run_bytes), math.ceil(sum(r.n_rows for r in old) * ROW_BYTES / (8 * SORT_BYTES)))
