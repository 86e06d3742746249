"""Compact columns for counts that are gathered per task and merged per bucket."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """Little-endian bytes by significance, without the planes that are all zero; their number first."""
    values = values.astype("<u8")  # negative numbers wrap and come back
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    octets = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(octets.T).tobytes()


def unplanes(data: bytes, count: int) -> np.ndarray:
    """The values that `planes` packed, as uint64."""
    width = data[0]
    octets = np.zeros((count, 8), np.uint8)
    octets[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, count).T
    return octets.view("<u8").ravel()
