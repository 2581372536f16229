"""Security events as structured records, without what must not be read."""

from __future__ import annotations

import json
import logging

log = logging.getLogger("plumbline.audit")

#: A detail whose name holds one of these is not shown.
HIDDEN = ("password", "passwd", "pwd", "secret", "token", "key", "pat", "api_key")
SHOWN_AS = "***REDACTED***"


def _hides(name: str) -> bool:
    return any(word in name.lower() for word in HIDDEN)


def event(kind: str, risk: str = "medium", **details) -> dict:
    """Log one event, as a line of JSON; the details as they were logged."""
    shown = {name: SHOWN_AS if _hides(name) else value for name, value in details.items()}
    log.warning(json.dumps({"event": kind, "risk": risk, "details": shown}, default=str, sort_keys=True), extra={"event": kind, "risk": risk})
    return shown
