"""Messages to standard output and, if wanted, to a file."""

from __future__ import annotations

import logging
import sys


def logger(name: str = "strataledger", path: str | None = None) -> logging.Logger:
    out = logging.getLogger(name)
    out.setLevel(logging.INFO)
    if not out.handlers:
        out.addHandler(logging.StreamHandler(sys.stdout))
    if path and not any(getattr(h, "baseFilename", None) == path for h in out.handlers):
        out.addHandler(logging.FileHandler(path))
    for h in out.handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    return out
