"""External object detectors as a map over frames."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# What an injected client is asked for one encoded frame; it returns the reply text and
# a finish reason.
Client = Callable[[bytes], tuple[str, str]]

RAW = "reply string, error string"


class Truncated(RuntimeError):
    """The reply hit the output limit; asking again would cut it again."""


def pace(rpm: int, *, shared: bool = False) -> float:
    """Seconds between calls; half the rate when agents share the quota."""
    return 60.0 / max(1, rpm // 2 if shared else rpm)


def backoff_seconds(attempt: int, jitter: float = 0.0) -> float:
    return min(60.0, 4.0 * 2.0**attempt) + jitter


def detect(
    frames: DataFrame,
    client_factory: Callable[[], Client],
    *,
    request_masks: bool = False,
    max_retries: int = 4,
    min_interval_s: float = 0.0,
    callers: int = 1,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Call the detector once per row of `(room, frame_idx, image)`.

    Rows come back with `reply` or, after the retries, `error`. `callers` tasks call at
    the same time, so the quota per call interval holds when `min_interval_s` is the
    interval of one caller times `callers`.
    """
    types = dict(frames.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, last = client_factory(), float("-inf")
        for batch in batches:
            out = []
            for image in batch["image"]:
                reply = problem = None
                for attempt in range(max_retries):
                    wait = min_interval_s - (time.monotonic() - last)
                    if wait > 0:
                        sleep(wait)
                    last = time.monotonic()
                    try:
                        reply, reason = client(bytes(image))
                        if "MAX_TOKENS" in str(reason or "").upper():
                            hint = "turn masks off" if request_masks else "raise the output limit"
                            raise Truncated(f"reply truncated at the output limit; {hint}")
                        if not reply:
                            raise RuntimeError("empty response")
                        problem = None
                        break
                    except Truncated as cut:
                        reply, problem = None, str(cut)
                        break
                    except Exception as failure:  # noqa: BLE001
                        reply, problem = None, str(failure)
                        if attempt + 1 < max_retries:
                            sleep(backoff_seconds(attempt, random.uniform(0, 2)))
                out.append((reply, problem))
            made = pd.DataFrame(out, columns=["reply", "error"])
            yield pd.concat([batch[["room", "frame_idx"]].reset_index(drop=True), made], axis=1)

    schema = f"room {types['room']}, frame_idx {types['frame_idx']}, {RAW}"
    return frames.select("room", "frame_idx", "image").repartition(callers).mapInPandas(run, schema)
