"""The circuit breaker online: failures in a row of each domain, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "domain string, ts timestamp, failures_in_a_row long, state string"


def circuit(stream: DataFrame, threshold: int = 5, open_seconds: float = 60.0) -> DataFrame:
    """A row for each fetch (domain, ts, success): failures in a row and closed, open or half_open after it.

    Open from so many failures in a row; the first fetch after the open time is a trial: if it fails the circuit
    opens again, if not it closes. Rows of one batch are taken in order of time."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        n, opened = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows.ts, rows.success):
            micros = int(ts.value // 1000)
            trial = opened and micros - opened >= open_seconds * 1e6
            n = 0 if ok else n + 1
            if ok:
                opened, name = 0, "closed"
            elif n >= threshold:
                opened, name = (micros if trial or not opened else opened), "open"
            else:
                name = "half_open" if trial else "closed"
            out.append((key[0], ts, n, name))
        state.update((n, opened))
        yield pd.DataFrame(out, columns=["domain", "ts", "failures_in_a_row", "state"])

    return stream.groupBy("domain").applyInPandasWithState(step, OUTPUT, "n long, opened long", "append", "NoTimeout")
