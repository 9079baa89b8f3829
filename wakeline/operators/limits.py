"""Work that may take so long and no longer."""

import uuid
from threading import Event

from pyspark import InheritableThread
from pyspark.sql import DataFrame


def count_within(df: DataFrame, seconds: float) -> int | None:
    """The count of rows, or None where it isn't there in time; its jobs are then cancelled."""
    sc = df.sparkSession.sparkContext
    group, done, out = f"count-{uuid.uuid4().hex}", Event(), []

    def work() -> None:
        sc.setJobGroup(group, "a count with a limit of time", interruptOnCancel=True)
        try:
            out.append(df.count())
        except Exception as failed:  # told to the caller below, unless the limit was the reason
            out.append(failed)
        finally:
            done.set()

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    if not done.wait(seconds):
        sc.cancelJobGroup(group)
        return None
    if isinstance(out[0], Exception):
        raise out[0]
    return out[0]
