"""Figures of byte blocks: plain functions, used by the analysis plan and by the entropy kernel."""

from __future__ import annotations

import numpy as np

HEAD = 4096


def entropy_bits(data: bytes) -> float:
    """Shannon entropy, in bits per byte, of the first 4096 bytes; 0 for none."""
    n = np.bincount(np.frombuffer(data, np.uint8, min(len(data), HEAD)), minlength=256)
    p = n[n > 0] / max(1, n.sum())
    return float(max(0.0, -(p * np.log2(p)).sum()))


def block_class(data: bytes, block: int) -> str:
    """zero, ff, text (under 5 bits a byte in the first 4096), high (over 7.5) or other."""
    zeros = data.count(0)
    if len(data) == block and data.count(255) == block:
        return "ff"
    if len(data) - zeros <= 16:
        return "zero"
    bits = entropy_bits(data)
    return "text" if bits < 5.0 else "high" if bits > 7.5 else "other"
