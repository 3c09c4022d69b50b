"""One time budget for a round of work, handed down to every call in it."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass


@dataclass(frozen=True)
class Deadline:
    """A moment on the monotonic clock; :meth:`unbounded` never comes."""

    at: float

    @classmethod
    def after(cls, seconds: float) -> Deadline:
        return cls(time.monotonic() + seconds)

    @classmethod
    def unbounded(cls) -> Deadline:
        return cls(math.inf)

    def remaining(self, now: float | None = None) -> float | None:
        """Seconds left; none, rather than 0, once it is over."""
        left = self.at - (time.monotonic() if now is None else now)
        return left if left > 0 else None

    def budget(self, most: float, now: float | None = None) -> float | None:
        """What one call may take: the lesser of ``most`` and what is left; none means that it must not begin."""
        left = self.remaining(now)
        return None if left is None else min(left, most)

    def expired(self) -> bool:
        return self.remaining() is None
