"""Spans inside texts: how they are written down and digested."""
from __future__ import annotations

import hashlib

from gleaner.llm.common import by_value

by_value(__name__)


def joined(spans) -> str:
    """kind:start:end, comma-joined in the given order."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
