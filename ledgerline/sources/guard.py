"""What keeps writers apart and files where they belong: locks, safe folders, kinds of failure, exit codes."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.text import scrub_text
from .scratch import file_system

OK, FAILED, PUBLISH_FAILED = 0, 1, 2


class Locked(RuntimeError):
    pass


@contextmanager
def writer_lock(spark: SparkSession, root: str, stale_s: float | None = None) -> Iterator[str]:
    """One writer for a store: a file in it that only one can create. ``stale_s`` takes over a lock that is older, whose
    owner is gone; by default a lock stays until its owner gives it back."""
    path = f"{root.rstrip('/')}/.writer.lock"
    fs, where = file_system(spark, path)
    own = uuid.uuid4().hex
    if stale_s is not None and fs.exists(where) and time.time() * 1000 - fs.getFileStatus(where).getModificationTime() > stale_s * 1000:
        fs.delete(where, False)
    try:
        out = fs.create(where, False)
    except Exception as e:
        raise Locked(f"another writer has {root}") from e
    out.write(bytearray(own, "ascii"))
    out.close()
    try:
        yield own
    finally:
        fs.delete(where, False)


def inside_work_tree(path: Path) -> bool:
    """Whether a folder belongs to a checked-out repository."""
    p = Path(os.path.abspath(path))
    return any((q / ".git").exists() for q in (p, *p.parents))


def check_out_folder(path: str, kept_apart: tuple[str, ...] = (), allow_work_tree: bool = False) -> Path:
    """A folder to export to: it must exist, outside of repositories and of the folders named (inbox, archive), which hold
    what isn't to be overwritten."""
    out = Path(path).resolve()
    if not out.is_dir():
        raise ValueError(f"no such folder: {out}")
    if not allow_work_tree and inside_work_tree(out):
        raise ValueError(f"{out} is inside a repository")
    for other in kept_apart:
        apart = Path(other).resolve()
        if out == apart or apart in out.parents or out in apart.parents:
            raise ValueError(f"{out} and {apart} may not hold one another")
    return out


def write_atomic(path: Path, data: bytes) -> None:
    """Readers see the old file or the new one; what is left of a failed write is taken away."""
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    try:
        part.write_bytes(data)
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


#: Kinds of failure by SQL state, or its class: fixed values.
_STATES = {"55P03": "lock_timeout", "57014": "statement_timeout"}
_CLASSES = {"08": "connection_lost", "23": "conflict"}


def failure_kind(error: BaseException | None) -> str:
    """lock_timeout, statement_timeout, connection_lost, conflict or other, of a relational target's error."""
    while error is not None:
        state = getattr(error, "sqlstate", None) or getattr(error, "getSQLState", lambda: None)() or getattr(getattr(error, "diag", None), "sqlstate", None)
        if state:
            return _STATES.get(state) or _CLASSES.get(str(state)[:2], "other")
        if isinstance(error, (ConnectionError, TimeoutError)):
            return "connection_lost"
        error = error.__cause__ or error.__context__
    return "other"


def publish_with_fallback(changes, everything) -> str:
    """Publish what changed; where that conflicts with what the target has, publish everything. Other failures are the
    caller's. Returns which of the two was done."""
    try:
        changes()
    except Exception as e:
        if failure_kind(e) != "conflict":
            raise
        everything()
        return "everything"
    return "changes"


def exit_code(failed_documents: int, page_errors: int, publish_error: str | None = None, differences: int = 0) -> int:
    """Of a run: documents or pages that failed, or differences that a check found, are 1, a failed publication is 2."""
    if publish_error is not None:
        return PUBLISH_FAILED
    return FAILED if failed_documents or page_errors or differences else OK


def message(error: BaseException, secrets: tuple[str, ...] = ()) -> str:
    return scrub_text(f"{type(error).__name__}: {error}", secrets)
