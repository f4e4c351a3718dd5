"""Logging to a file of one JSON object a line."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "data", {})}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger; with a path it writes there as well, once however often it is asked for."""
    log = logging.getLogger(f"graphloom.{name}")
    log.setLevel(logging.INFO)
    if path and not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        handler = logging.FileHandler(path)
        handler.setFormatter(_Lines())
        log.addHandler(handler)
    return log
