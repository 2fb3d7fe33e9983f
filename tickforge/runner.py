"""Stages in dependency order: a stage runs only if all it depends on succeeded."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tickforge.operators.lineage import Recorder


def retried(call: Callable[[], object], attempts: int = 5, wait: float = 1.0, on: tuple[type[BaseException], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``; errors of the kinds ``on`` are tried again after twice the wait each time, the last is raised."""
    for k in range(attempts):
        try:
            return call()
        except on:
            if k + 1 == attempts:
                raise
            sleep(wait * 2**k)


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[], dict | None]
    after: tuple[str, ...] = field(default=())


def run_stages(stages: list[Stage], recorder: Recorder | None = None) -> dict[str, str]:
    """State of each stage: success, failed or upstream_failed. A failure doesn't stop unrelated stages."""
    recorder, state, left = recorder or Recorder(None), {}, list(stages)
    names = {s.name for s in stages}
    while left:
        ready = next((s for s in left if all(a in state for a in s.after)), None)
        if ready is None:
            raise ValueError(f"stages wait for each other or for unknown ones: {[s.name for s in left]} of {sorted(names)}")
        left.remove(ready)
        if any(state[a] != "success" for a in ready.after):
            state[ready.name] = "upstream_failed"
            continue
        try:
            with recorder.run(ready.name) as metrics:
                metrics.update(ready.run() or {})
            state[ready.name] = "success"
        except Exception:
            state[ready.name] = "failed"
    return state
