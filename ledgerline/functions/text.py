"""Words that must not get into logs and messages, as plain functions and column expressions."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a secret stands behind: a URL's user part, and settings named like one.
_USER = r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@]+@"
_SETTING = r"(?i)\b(password|passwd|pwd|token|secret|api[_-]?key)(\s*[=:]\s*)('[^']*'|\"[^\"]*\"|[^\s,;&]+)"
HIDDEN = "***"


def scrub_text(text: str, secrets: tuple[str, ...] = ()) -> str:
    """A message without the given secrets, URLs' user parts, and the values of settings named like secrets."""
    for s in sorted({x for x in secrets if x}, key=len, reverse=True):
        text = text.replace(s, HIDDEN)
    text = re.sub(_USER, rf"\1{HIDDEN}@", text)
    return re.sub(_SETTING, rf"\1\2{HIDDEN}", text)


def scrub(text: Column) -> Column:
    """scrub_text() on a column, without given secrets."""
    return F.regexp_replace(F.regexp_replace(text, _USER, f"$1{re.escape(HIDDEN)}@".replace("\\", "")), _SETTING, f"$1$2{HIDDEN}")


def describe_url(url: str) -> str:
    """A target by its kind, host, port and database, without users, passwords and options."""
    u = urlsplit(url.removeprefix("jdbc:"))
    port = f":{u.port}" if u.port else ""
    return f"{u.scheme}://{u.hostname or ''}{port}{u.path}"
