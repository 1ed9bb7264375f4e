"""One writer at a time, by a file that only one process can create; for jobs outside Spark's own commit protocol."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path


@contextmanager
def writer_lock(path: str, stale: float = 1800.0) -> Iterator[Callable[[], None]]:
    """Holds the lock and gives a function that renews it; a lock that wasn't renewed for ``stale`` seconds is taken over."""
    lock, token = Path(path), f"{os.getpid()}-{time.time_ns()}"

    def write(mode: str) -> None:
        with open(lock, mode, encoding="utf-8") as f:
            json.dump({"owner": token, "renewed": time.time()}, f)

    def held_by() -> dict:
        try:
            return json.loads(lock.read_text(encoding="utf-8"))
        except (FileNotFoundError, ValueError):
            return {}

    try:
        write("x")
    except FileExistsError:
        if time.time() - held_by().get("renewed", lock.stat().st_mtime) < stale:
            raise RuntimeError(f"{path} is held by another writer") from None
        lock.unlink(missing_ok=True)
        write("x")
    try:
        yield lambda: write("w")
    finally:
        if held_by().get("owner") == token:
            lock.unlink(missing_ok=True)


def run_once(lock: str, recover: Callable[[], None], job: Callable[[], None]) -> int:
    """A job behind the lock, after recovery: 0 if it ran, 1 if it failed, 2 if another writer is at work."""
    try:
        with writer_lock(lock):
            recover()
            job()
    except RuntimeError as e:
        return 2 if "another writer" in str(e) else 1
    except Exception:  # noqa: BLE001 - the code of the process tells
        return 1
    return 0
