"""Extents, triggers and their state for one group, segment by segment: what a stream's processor holds.

Plain Python without Spark, so it also serves as the model that batch replay is tested against.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from millrace.model import Trigger, Window
from millrace.operators.aggregations import Aggregation, fold_of
from millrace.units import standard

GLOBAL = (None, None)


@dataclass
class Group:
    """State of one group: each extent's aggregate, and the trigger's own."""

    extents: dict[tuple, Any] = field(default_factory=dict)
    trigger: Any = None


@dataclass
class CustomTrigger:
    """A user's trigger: next_state(trigger, state, event) for each event of a group, fire(trigger, state, event, extent)
    for each extent."""

    init: Any
    next_state: Any
    fire: Any


class Fold:
    def __init__(self, window: Window, trigger: Trigger):
        self.window, self.trigger = window, trigger
        self.own: Aggregation = fold_of(window.aggregation, window.init)
        size = lambda x: standard(x)[0] if x is not None else None
        self.range, self.gap = size(window.range), size(window.timeout_gap)
        self.slide = size(window.slide) or self.range
        self.n, self.period, self.delay = size(trigger.threshold), size(trigger.period), size(trigger.delay) or 0

    def extents_of(self, t: int | None) -> list[tuple]:
        """Extents of a key in fixed, sliding and global windows."""
        if self.window.type == "global":
            return [GLOBAL]
        m, r, s = self.window.min_value, self.range, self.slide
        return [(max(m, m + s * (w + 1) - r), m + s * (w + 1) - 1) for w in range((t - m) // s, (t + r - m) // s)]

    def _new(self) -> Any:
        return self.own.init() if self.own.init else self.window.init

    def add(self, group: Group, segment: dict, t: int | None) -> list[tuple]:
        """Puts a segment in its extents and returns these. A session that it reaches grows; two that it joins merge,
        the earlier one's state first."""
        if self.window.type != "session":
            touched = self.extents_of(t)
        else:
            near = sorted(e for e in group.extents if e[0] - self.gap <= t <= e[1] + self.gap)
            extent = (min([t, *(e[0] for e in near)]), max([t, *(e[1] for e in near)]))
            if near:
                states = [group.extents.pop(e) for e in near]
                merged = states[0]
                for s in states[1:]:
                    merged = self.own.merge(merged, s)
                group.extents[extent] = merged
            touched = [extent]
        for e in touched:
            state = group.extents.get(e)
            group.extents[e] = self.own.apply(self._new() if state is None else state, self.own.create(segment))
        return touched

    def _step(self, group: Group, event: dict) -> bool:
        """Moves the trigger's own state on by an event; whether it fires as far as that tells."""
        on, kind = self.trigger.on, event["type"]
        ending = kind in ("job-completed", "recovered")
        if on == "segment":
            if kind == "new-segment":
                group.trigger = 1 + (group.trigger or 0) % self.n
                return group.trigger == self.n
            return ending
        if on == "timer":
            now = event.get("now", 0)
            due = group.trigger is not None and now >= group.trigger
            if due or group.trigger is None:
                group.trigger = now + self.period
            return due or ending
        if isinstance(on, CustomTrigger):
            group.trigger = on.next_state(self.trigger, on.init if group.trigger is None else group.trigger, event)
        return ending

    def _fires(self, group: Group, event: dict, extent: tuple, stepped: bool) -> bool:
        on, kind = self.trigger.on, event["type"]
        if on in ("segment", "timer"):
            return stepped
        if on == "punctuation":
            return bool(self.trigger.pred(self.trigger, event | {"lower": extent[0], "upper": extent[1]}))
        if on == "watermark":
            return kind == "job-completed" or kind == "watermark" and event["watermark"] > extent[1] + self.delay
        if on == "percentile-watermark":
            at = lambda: extent[0] + self.trigger.watermark_percentage * (extent[1] - extent[0])
            return stepped or kind == "new-segment" and event["t"] >= at()
        return bool(on.fire(self.trigger, group.trigger, event, extent))

    def event(self, group: Group, event: dict) -> list[tuple[tuple, Any]]:
        """Applies an event, {"type": ..., "segment": ..., "t": ...}; returns what is released: (extent, state)."""
        touched = self.add(group, event["segment"], event.get("t")) if event["type"] == "new-segment" else []
        stepped = self._step(group, event)
        every = event["type"] != "new-segment" or self.trigger.fire_all_extents
        out = []
        for extent in sorted(group.extents, key=lambda e: (e[0] is not None, e)) if every else touched:
            if extent not in group.extents or not self._fires(group, event, extent, stepped):
                continue
            if self.trigger.refinement is not None:
                group.extents[extent] = self.trigger.refinement(group.extents[extent])
            out.append((extent, group.extents[extent]))
            if self.trigger.post_evictor == "all":
                del group.extents[extent]
        return out

    def run(self, segments: Iterable[tuple[dict, int | None]], completion: bool = False) -> list[tuple[int | None, tuple, Any]]:
        """All releases over segments in order, as (number of the segment or None at completion, extent, state)."""
        group, out = Group(), []
        for i, (segment, t) in enumerate(segments):
            out += [(i, e, s) for e, s in self.event(group, {"type": "new-segment", "segment": segment, "t": t})]
        if completion:
            out += [(None, e, s) for e, s in self.event(group, {"type": "job-completed"})]
        return out
