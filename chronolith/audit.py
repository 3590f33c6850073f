"""Traces of what an engine did."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field


@dataclass
class Event:
    stage: str
    action: str
    inputs: dict
    outputs: dict
    duration_ms: float = 0.0
    metadata: dict = field(default_factory=dict)


@dataclass
class Trace:
    operation: str
    question: str = ""
    strategy: str = ""
    started_at: float = field(default_factory=time.time)
    total_duration_ms: float = 0.0
    events: list[Event] = field(default_factory=list)

    def add(self, stage: str, action: str, inputs: dict | None = None, outputs: dict | None = None, duration_ms: float = 0.0, **metadata: object) -> None:
        self.events.append(Event(stage, action, inputs or {}, outputs or {}, duration_ms, metadata))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)

    def render(self) -> str:
        head = f"{self.operation} {self.question!r} ({self.strategy or 'default'}): {self.total_duration_ms:.0f} ms"
        return "\n".join([head, *(f"  {e.stage}/{e.action} {e.inputs} -> {e.outputs} ({e.duration_ms:.0f} ms)" for e in self.events)])


class Auditor:
    """Keeps the last trace; does nothing until it is enabled."""

    def __init__(self) -> None:
        self.enabled, self.last = False, None

    @contextmanager
    def record(self, operation: str, question: str = "") -> Iterator[Trace]:
        trace, began = Trace(operation, question), time.perf_counter()
        try:
            yield trace
        finally:
            trace.total_duration_ms = (time.perf_counter() - began) * 1000
            if self.enabled:
                self.last = trace
