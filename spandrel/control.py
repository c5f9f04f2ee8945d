"""Timeouts, cancellation and cleanup of driver-side actions, by job tags."""

from __future__ import annotations

import os
import signal
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from .operators.codecs import FrameError
from .operators.frames import Options

T = TypeVar("T")


class Token:
    """A flag that asks an action to stop."""

    def __init__(self) -> None:
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    def reset(self) -> None:
        self._event.clear()

    def is_cancelled(self) -> bool:
        return self._event.is_set()

    def check(self) -> None:
        if self.is_cancelled():
            raise FrameError("Cancelled", "Operation cancelled")


class CancelOnExit:
    """Leaving sets the token, however it is left; what still works for it then stops. `dismiss` lets it be."""

    def __init__(self, token: Token):
        self.token, self.armed = token, True

    def dismiss(self) -> None:
        self.armed = False

    def __enter__(self) -> CancelOnExit:
        return self

    def __exit__(self, *_: object) -> None:
        if self.armed:
            self.token.cancel()


def bounded(spark: SparkSession, action: Callable[[], T], seconds: float = 0.0, token: Token | None = None, poll: float = 0.02) -> T:
    """Run an action, such as a write. After `seconds` (0: without end), or when the token asks, its jobs are cancelled
    and an error of kind Timeout or Cancelled is raised, with the token set, so that what else works for it stops too; an
    action that fails by itself raises its own error."""
    token = token or Token()
    token.check()
    with CancelOnExit(token) as guard:
        done = _watch(spark, action, seconds, token, poll)
        guard.dismiss()
    if "error" in done:
        raise done["error"]
    return done["value"]


def _watch(spark: SparkSession, action: Callable[[], T], seconds: float, token: Token, poll: float) -> dict[str, object]:
    """What an action gave: its value or its error."""
    tag = f"frames-{uuid.uuid4().hex}"
    context = spark.sparkContext
    done: dict[str, object] = {}

    def run() -> None:
        context.addJobTag(tag)
        try:
            done["value"] = action()
        except BaseException as e:
            done["error"] = e
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    waited = 0.0
    while thread.is_alive():
        thread.join(poll)
        waited += poll
        late = 0 < seconds <= waited
        if thread.is_alive() and (late or token.is_cancelled()):
            context.cancelJobsWithTag(tag)
            thread.join(5)
            raise FrameError("Timeout", f"Operation timed out after {seconds:g}s") if late else FrameError("Cancelled", "Operation cancelled")
    return done


def perform(spark: SparkSession, action: Callable[[], T], options: Options) -> T:
    """Run an action under the timeout and the token of options."""
    return bounded(spark, action, options.timeout, options.token)


class Resources:
    """Output and temporary files of an operation. Unless it is marked complete, leaving removes both; an explicit cleanup
    removes temporary files in any case, and outputs of an operation that is not complete."""

    def __init__(self) -> None:
        self.outputs: list[str] = []
        self.temporary: list[str] = []
        self.complete = False

    def output(self, path: str) -> str:
        self.outputs.append(path)
        return path

    def temp(self, path: str) -> str:
        self.temporary.append(path)
        return path

    def mark_complete(self) -> None:
        self.complete = True

    def cleanup(self) -> None:
        for path in self.temporary + ([] if self.complete else self.outputs):
            if os.path.exists(path):
                os.remove(path)

    def __enter__(self) -> Resources:
        return self

    def __exit__(self, *_: object) -> None:
        if not self.complete:
            self.cleanup()


def on_interrupt(spark: SparkSession, token: Token) -> None:
    """Ctrl+C sets the token and cancels running jobs; the action then raises, and the CLI leaves with 130."""

    def handle(*_: object) -> None:
        token.cancel()
        spark.sparkContext.cancelAllJobs()

    if threading.current_thread() is threading.main_thread():  # only there a handler can be set
        signal.signal(signal.SIGINT, handle)
