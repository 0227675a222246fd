"""A bank of vectors as the state of a stream: moved by every step, replaced at every refresh."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The vector, steps taken, the open epoch and step, sums and counts of the open step and epoch, and
#: whether the key has been seen in an epoch that was closed.
STATE = "mean array<double>, moves long, epoch long, step long, step_sum array<double>, step_n long, epoch_sum array<double>, epoch_n long"


class Entry:
    """One key's vector, with what its open step and epoch have gathered."""

    def __init__(self, held: tuple | None = None):
        self.mean, self.moves, self.epoch, self.step, self.step_sum, self.step_n, self.epoch_sum, self.epoch_n = held or (None, 0, None, None, None, 0, None, 0)

    def held(self) -> tuple:
        plain = lambda v: None if v is None else [float(x) for x in v]
        return plain(self.mean), self.moves, self.epoch, self.step, plain(self.step_sum), self.step_n, plain(self.epoch_sum), self.epoch_n

    def close_step(self, total: int) -> bool:
        """The open step's mean of k rows moves the vector by k / total; the first one of all is the vector."""
        if not self.step_n:
            return False
        mu = np.asarray(self.step_sum) / self.step_n
        self.mean = mu if self.mean is None else np.asarray(self.mean) + (mu - np.asarray(self.mean)) * (self.step_n / total)
        self.moves += 1
        self.step_sum, self.step_n = None, 0
        return True

    def close_epoch(self, refresh: bool) -> bool:
        """The mean of all rows of the epoch takes the vector's place."""
        done = bool(self.epoch_n)
        if done and refresh:
            self.mean = np.asarray(self.epoch_sum) / self.epoch_n
        self.epoch_sum, self.epoch_n = None, 0
        return done

    def add(self, v) -> None:
        v = np.asarray(v, np.float64)
        self.step_sum, self.step_n = (v if self.step_sum is None else np.asarray(self.step_sum) + v), self.step_n + 1
        self.epoch_sum, self.epoch_n = (v if self.epoch_sum is None else np.asarray(self.epoch_sum) + v), self.epoch_n + 1


def bank_stream(stream: DataFrame, key: str, epoch: str, step: str, vec: str, total: str, refresh: bool = True, time: str | None = None, epoch_ms: int | None = None) -> DataFrame:
    """A stream of (key, epoch, step, moves, refreshed, mean) whenever a key's vector has moved or was replaced.

    Rows of (key, epoch, step, vector, total rows of the key) come with steps that do not fall; a step may
    lie in several micro-batches, so it counts when the key's next one comes.  A row whose vector is null
    closes what is open.  At the end of an epoch the mean of its rows takes the vector's place (refresh).
    A step that comes too late raises.

    time, epoch_ms: a column of event times, on which the stream has a watermark, and an epoch's length:
    epoch e ends at (e + 1) * epoch_ms, and when the watermark passes that, keys without further rows are
    refreshed too.  State is one entry for each key, in the checkpoint of the query.
    """
    kinds = dict(stream.dtypes)
    timed = time is not None

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, out = Entry(tuple(state.get) if state.exists else None), []

        def tell(moved: bool, refreshed: bool) -> None:
            if moved or refreshed:
                out.append((k[0], entry.epoch, entry.step, entry.moves, refreshed, None if entry.mean is None else [float(x) for x in entry.mean]))

        def close(n: int) -> None:
            moved = entry.close_step(n)
            if moved:
                tell(True, False)
            if entry.close_epoch(refresh) and refresh:
                tell(False, True)

        if state.hasTimedOut:
            # The key's rows have all been seen; its total is at least what the open step has.
            close(max(entry.epoch_n, 1))
        else:
            rows = pd.concat(list(batches)).sort_values([epoch, step], kind="stable")
            for e, s, v, n in zip(rows[epoch], rows[step], rows[vec], rows[total], strict=True):
                e, s, n = int(e), int(s), int(n)
                if entry.epoch is not None and (e, s) < (entry.epoch, entry.step):
                    raise ValueError(f"step {s} of epoch {e} comes after step {entry.step} of epoch {entry.epoch}")
                if entry.epoch is not None and e > entry.epoch:
                    close(n)
                elif entry.step is not None and s > entry.step:
                    tell(entry.close_step(n), False)
                entry.epoch, entry.step = e, s
                if v is None:
                    close(n)
                else:
                    entry.add(v)
        state.update(entry.held())
        if timed and entry.epoch is not None and entry.epoch_n:
            state.setTimeoutTimestamp(max((entry.epoch + 1) * epoch_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "epoch", "step", "moves", "refreshed", "mean"])

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, epoch long, step long, moves long, refreshed boolean, mean array<double>", STATE, "append", timeout)
