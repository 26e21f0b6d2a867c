"""A function run in a child process with limits of time and memory, for comparisons that may not end."""

from __future__ import annotations

import multiprocessing
import resource
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

# Seconds of wall and processor time and megabytes that one comparison may take.
WALL, CPU, MEMORY_MB = 2.0, 2, 4096


def _serve(pipe, call: Callable, memory_mb: int) -> None:
    try:
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
    except (ValueError, OSError):  # a lower limit holds already
        pass
    while True:
        try:
            args = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send(("ok", call(*args)))
        except Exception as fault:  # the caller gets it as a status
            pipe.send(("internal_error", type(fault).__name__))


def _used(pid: int) -> float:
    """Processor seconds of a process so far."""
    import os

    with open(f"/proc/{pid}/stat") as stat:
        fields = stat.read().rpartition(")")[2].split()
    return (int(fields[11]) + int(fields[12])) / os.sysconf("SC_CLK_TCK")


class Bounded:
    """``call`` in a child that is kept between calls, killed when one is over its limits, and started anew for the next.

    The result is (``ok``, value), (``timeout``, null) or (``internal_error``, what happened), also when the child dies.
    """

    def __init__(self, call: Callable, wall: float = WALL, cpu: float = CPU, memory_mb: int = MEMORY_MB):
        self.call, self.wall, self.cpu, self.memory_mb, self.child, self.pipe = call, wall, cpu, memory_mb, None, None

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, end = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(end, self.call, self.memory_mb), daemon=True)
        self.child.start()
        end.close()

    def __call__(self, *args) -> tuple:
        import time

        if self.child is None or not self.child.is_alive():
            self.close()
            self._start()
        start, before = time.monotonic(), _used(self.child.pid)
        try:
            self.pipe.send(args)
            while not self.pipe.poll(0.05):
                if not self.child.is_alive():
                    self.close()
                    return "internal_error", "died"
                if time.monotonic() - start > self.wall or _used(self.child.pid) - before > self.cpu:
                    self.close()
                    return "timeout", None
            return self.pipe.recv()
        except (EOFError, OSError):
            self.close()
            return "internal_error", "died"

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def comparator(compare: Callable[[str, str], str], wall: float = WALL, cpu: float = CPU, memory_mb: int = MEMORY_MB) -> Callable:
    """A column function (prediction, reference) -> status made of any comparison of two texts; ``timeout`` and ``internal_error`` are statuses.

    One child for each batch of rows. A null reference is ``invalid_reference``, a null prediction ``invalid_prediction``.
    """

    @F.pandas_udf("string")
    def run(prediction: pd.Series, reference: pd.Series) -> pd.Series:
        bounded = Bounded(compare, wall, cpu, memory_mb)

        def one(p: str | None, r: str | None) -> str:
            if r is None or p is None:
                return "invalid_reference" if r is None else "invalid_prediction"
            status, value = bounded(p, r)
            return value if status == "ok" else status

        try:
            return pd.Series([one(p, r) for p, r in zip(prediction, reference, strict=True)], dtype=object)
        finally:
            bounded.close()

    return run
