"""Results of dashboard queries kept for a while: fresh, then stale while one caller refreshes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, TimeoutError
from dataclasses import dataclass


@dataclass(frozen=True)
class Answer:
    rows: list[dict]
    as_of: float


class QueryCache:
    """Runs a query at most once at a time for each key.

    A result younger than ``ttl_s`` is given as it is; one younger than ``stale_s`` is given while a refresh runs in the
    background; otherwise the caller waits, at most ``timeout_s``. A failed refresh keeps the old result.
    """

    def __init__(self, ttl_s: float = 10, stale_s: float = 60, timeout_s: float = 30, now: Callable[[], float] = time.time, threads: int = 1):
        self.ttl_s, self.stale_s, self.timeout_s, self._now = ttl_s, stale_s, timeout_s, now
        self._held: dict[str, Answer] = {}
        self._running: dict[str, Future] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(threads, thread_name_prefix="queries")

    def get(self, key: str, run: Callable[[], list[dict]]) -> Answer:
        held = self._held.get(key)
        age = self._now() - held.as_of if held else None
        if held and age < self.ttl_s:
            return held
        future = self._refresh(key, run)
        if held and age < self.stale_s:
            return held
        try:
            return future.result(self.timeout_s)
        except TimeoutError:
            raise TimeoutError(f"no result of {key} within {self.timeout_s} s") from None

    def _refresh(self, key: str, run: Callable[[], list[dict]]) -> Future:
        with self._lock:
            if key not in self._running:

                def work() -> Answer:
                    try:
                        answer = Answer(run(), self._now())
                        self._held[key] = answer
                        return answer
                    finally:
                        with self._lock:
                            self._running.pop(key, None)

                self._running[key] = self._pool.submit(work)
            return self._running[key]

    def refresh_all(self, queries: dict[str, Callable[[], list[dict]]]) -> None:
        """Start a refresh of every query that isn't running, as a schedule would."""
        for key, run in queries.items():
            self._refresh(key, run)

    def close(self) -> None:
        self._pool.shutdown()
