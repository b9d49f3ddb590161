"""Reordering with grace, greedy sampling, plan selection and rate limits."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class ReorderBuffer:
    """Holds one van's pings back for ``grace`` and releases them in order of device time, then number.

    A ping before the last one released is late and not taken. A terminal ping, or more than ``most``
    waiting, lets everything go at the next drain. Times are in any one unit.
    """

    grace: int = 3_000_000
    most: int = 50
    terminal: str = "RETURNED"
    waiting: list[tuple] = field(default_factory=list)  # (time, number, status, payload)
    released: int | None = None
    flush: bool = False

    def offer(self, time: int, number: int, status: str | None = None, payload: object = None) -> bool:
        if self.released is not None and time < self.released:
            return False
        insort(self.waiting, (time, number, status, payload), key=lambda w: (w[0], w[1]))
        self.flush |= status == self.terminal or len(self.waiting) > self.most
        return True

    def drain(self, now: int) -> list[tuple]:
        if self.flush:
            ready, self.waiting, self.flush = self.waiting, [], False
        else:
            n = 0
            while n < len(self.waiting) and self.waiting[n][0] < now - self.grace:
                n += 1
            ready, self.waiting = self.waiting[:n], self.waiting[n:]
        if ready:
            self.released = max(ready[-1][0], self.released if self.released is not None else ready[-1][0])
        return ready


@dataclass
class Throttle:
    """Lets an update pass if it's the first, its status changed, or ``interval`` has gone by since the last that passed."""

    interval: int
    on_change: bool = True
    always: str | None = None  # a status that always passes
    last: int | None = None
    status: str | None = None

    def due(self, time: int, status: str | None = None) -> bool:
        pass_ = self.last is None or time - self.last >= self.interval or (self.on_change and status != self.status) or (self.always is not None and status == self.always)
        if pass_:
            self.last, self.status = time, status
        return pass_


@dataclass
class NewestPlan:
    """The plan of one van: a higher version of the same route, or a route that wasn't made before the held one."""

    route: str | None = None
    version: int = 0
    created: int | None = None

    def put(self, route: str, version: int, created: int | None) -> bool:
        if self.route is not None:
            if route == self.route and version <= self.version:
                return False
            if route != self.route and None not in (created, self.created) and created < self.created:
                return False
        self.route, self.version, self.created = route, version, created
        return True


@dataclass
class TokenBuckets:
    """Requests let through by a bucket for each client and one for all; a refusal takes nothing from either."""

    burst: float = 3
    per_minute: float = 6
    all_per_minute: float = 60
    idle_s: float = 600
    clients: dict[str, list[float]] = field(default_factory=dict)  # tokens, time
    everyone: list[float] | None = None

    @staticmethod
    def _level(bucket: list[float], now: float, rate: float, most: float) -> float:
        return min(most, bucket[0] + max(0.0, now - bucket[1]) * rate / 60)

    def try_acquire(self, client: str, now: float) -> bool:
        for key in [k for k, b in self.clients.items() if now - b[1] > self.idle_s]:
            del self.clients[key]
        own = self._level(self.clients.get(client, [self.burst, now]), now, self.per_minute, self.burst)
        all_ = self._level(self.everyone or [self.all_per_minute, now], now, self.all_per_minute, self.all_per_minute)
        passed = own >= 1 and all_ >= 1
        self.clients[client] = [own - passed, now]
        self.everyone = [all_ - passed, now]
        return passed


def retried(work: Callable[[], object], times: int = 3, wait: Callable[[float], None] | None = None, first_s: float = 0.2, most_s: float = 2.0) -> object:
    """The result of ``work``, tried again after growing pauses; the last error is raised."""
    import time as clock

    pause = first_s
    for left in range(times, -1, -1):
        try:
            return work()
        except Exception:
            if not left:
                raise
            (wait or clock.sleep)(pause)
            pause = min(most_s, pause * 2)
