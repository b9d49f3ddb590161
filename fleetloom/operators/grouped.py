"""Whole groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Call ``work`` on frames that hold only whole groups, of a stream that is sorted by ``keys``.

    Many groups are given at once, so that ``work`` can be vectorised over all of them. The last
    group of a batch waits for the next one.
    """
    waiting: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame[keys].iloc[-1]
        here = frame[keys[0]].eq(last[keys[0]])
        for k in keys[1:]:
            here &= frame[k].eq(last[k])
        if bool(here.all()) and waiting and all(waiting[-1][k].iloc[-1] == last[k] for k in keys):
            waiting.append(frame)
            continue
        done, rest = frame[~here.to_numpy()], frame[here.to_numpy()]
        ready = pd.concat([*waiting, done], ignore_index=True) if waiting else done.reset_index(drop=True)
        if len(ready):
            yield work(ready)
        waiting = [rest]
    if waiting:
        yield work(pd.concat(waiting, ignore_index=True))
