"""Calls with a deadline: a forked helper of the task does the work and is killed when it takes too long or dies."""

from __future__ import annotations

import contextlib
import ctypes
import multiprocessing
import pickle
import signal
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import Any

_SET_DEATH_SIGNAL = 1  # of prctl: the helper goes when its task's process goes


class OverdueError(Exception):
    """The call took longer than its deadline."""


class EndedError(Exception):
    """The helper died during the call, as native programs do."""


def _travelling(problem: Exception) -> Exception:
    """The exception itself, or one that tells it where it cannot be pickled and read again."""
    try:
        pickle.loads(pickle.dumps(problem))
    except Exception:  # noqa: BLE001
        return RuntimeError(f"{type(problem).__name__}: {problem}")
    return problem


def _serve(pipe: Connection, make: Callable[[], Callable[..., Any]]) -> None:
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).prctl(_SET_DEATH_SIGNAL, signal.SIGKILL)
    signal.signal(signal.SIGTERM, signal.SIG_DFL)
    call = make()
    with contextlib.suppress(EOFError, OSError):
        while True:
            asked = pipe.recv()
            try:
                told = (True, call(*asked))
            except Exception as problem:
                told = (False, _travelling(problem))
            pipe.send(told)


class Helper:
    """Answers calls of one function in a process of its own. `make` gives the function inside that process, so state lives there.

    limit: seconds for a call, None for no limit and no process. Close it, or use it as a context manager: nothing is left behind.
    """

    def __init__(self, make: Callable[[], Callable[..., Any]], limit: float | None):
        self.make, self.limit = make, limit
        self.process: multiprocessing.process.BaseProcess | None = None
        self.pipe: Connection | None = None
        self.call: Callable[..., Any] | None = None

    def __enter__(self) -> Helper:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __call__(self, *asked: Any) -> Any:
        if self.limit is None:
            self.call = self.call or self.make()
            return self.call(*asked)
        if self.process is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.process = fork.Process(target=_serve, args=(theirs, self.make), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.pipe.send(asked)
            if not self.pipe.poll(self.limit):
                self.close()
                raise OverdueError(f"no answer within {self.limit:g} seconds")
            good, told = self.pipe.recv()
        except (EOFError, ConnectionError):
            code = self._ended()
            raise EndedError(f"the extractor's process ended with code {code}") from None
        if not good:
            raise told
        return told

    def _ended(self) -> int | None:
        self.process.join(5)
        code = self.process.exitcode
        self.close()
        return code

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process.close()
            self.pipe.close()
            self.process = self.pipe = None
