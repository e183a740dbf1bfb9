"""Statistics of a mail stream in state of fixed size: counts, the first samples, and the most frequent senders, a key each.

Senders are counted by space-saving: so many counters are kept; a sender without one takes over the smallest and its count, so
a count is too high by no more than its `error`, and every sender with more than n / counters mails is among them. State
lives in the query's checkpoint, so a restart goes on where it was. With idle_ms a key that nothing has come for is dropped
after so long; such a query wakes up for that by itself, so it never ends under an availableNow trigger.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n bigint, samples string, senders string"
RESULT = "kind string, n bigint, samples array<string>, senders array<struct<sender:string,n:bigint,error:bigint>>"


def counted(counters: dict[str, list[int]], sender: str, most: int) -> None:
    """One more mail of a sender; counters: sender to [count, error]."""
    if sender in counters:
        counters[sender][0] += 1
    elif len(counters) < most:
        counters[sender] = [1, 0]
    else:
        least = min(counters, key=lambda s: (counters[s][0], s))
        n, _ = counters.pop(least)
        counters[sender] = [n + 1, n]


def inbox_statistics(stream: DataFrame, samples: int = 10, counters: int = 100, top: int = 10, idle_ms: int = 0) -> DataFrame:
    """kind, n, samples, senders of stream (kind, sender, subject, at), in update mode: a row for each kind that a micro-batch brings
    something of. Samples are the first subjects by arrival, within a batch by `at` and text."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, senders = state.get if state.exists else (0, "[]", "{}")
        first, senders = json.loads(first), json.loads(senders)
        rows = pd.concat(list(frames)).sort_values(["at", "subject", "sender"], kind="stable")
        for sender, subject in zip(rows["sender"], rows["subject"], strict=True):
            n += 1
            if len(first) < samples:
                first.append(subject)
            if sender is not None:
                counted(senders, sender, counters)
        state.update((n, json.dumps(first), json.dumps(senders)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        best = sorted(senders.items(), key=lambda s: (-s[1][0], s[0]))[:top]
        yield pd.DataFrame({"kind": [key[0]], "n": [n], "samples": [first], "senders": [[{"sender": s, "n": c, "error": e} for s, (c, e) in best]]})

    rows = stream.select("kind", "sender", "subject", "at")
    return rows.groupBy("kind").applyInPandasWithState(step, RESULT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
