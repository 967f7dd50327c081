"""Decisions from a user-supplied callable, for uncertain rows only."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sieveguard.functions.columns import decision_payload, decision_result

MAX_BATCH = 256

# Takes JSON requests, returns one (http status, body) pair per request.
Caller = Callable[[list[str]], list[tuple[int, str]]]


def _message(kind: str, error: BaseException) -> str:
    return f"{kind}:{str(error) or type(error).__name__}"


@dataclass
class _Request:
    rows: pd.DataFrame
    deadline: float
    tries: int = 1


class _Window:
    """Requests in flight, answered in whatever order they end.

    Each call has a thread of its own, so one that never returns costs its thread and its own
    rows, and gives its place in the window back at its deadline.
    """

    def __init__(self, call: Caller, timeout_s: float, retries: int) -> None:
        self.call, self.timeout_s, self.retries = call, timeout_s, retries
        self.ended: queue.SimpleQueue = queue.SimpleQueue()
        self.open: dict[int, _Request] = {}
        self.made = 0

    def start(self, request: _Request) -> None:
        self.made += 1
        number, payloads = self.made, request.rows["payload"].tolist()
        self.open[number] = request

        def run() -> None:
            try:
                self.ended.put((number, self.call(payloads), None))
            except Exception as problem:  # any error of the callable becomes a failure row
                self.ended.put((number, None, problem))

        threading.Thread(target=run, daemon=True).start()

    def send(self, rows: pd.DataFrame) -> None:
        self.start(_Request(rows, time.monotonic() + self.timeout_s))

    def next(self) -> Iterator[pd.DataFrame]:
        """Wait for one answer, or for the first deadline, and give the rows this settles."""
        first = min(r.deadline for r in self.open.values())
        try:
            number, replies, problem = self.ended.get(timeout=max(0.0, first - time.monotonic()))
        except queue.Empty:
            now = time.monotonic()
            for number in [n for n, r in self.open.items() if r.deadline <= now]:
                yield _answer(self.open.pop(number).rows, None, TimeoutError())
            return
        request = self.open.pop(number, None)
        if request is None:      # its deadline is over, its rows are settled
            return
        if problem is not None and request.tries <= self.retries:
            self.start(_Request(request.rows, request.deadline, request.tries + 1))
        else:
            yield _answer(request.rows, replies, problem)


def external_decision(df: DataFrame, call: Caller, timeout_s: float = 15.0,
                      concurrency: int = 1, batch: int = 64, retries: int = 0) -> DataFrame:
    """Decision rows of the external system for the uncertain rows of ``df``.

    Every task keeps up to ``concurrency`` requests of up to ``batch`` rows in flight and gives
    out answers as they come, in no order: a slow request delays no other. ``timeout_s`` is the
    deadline of a request, all its tries included; one that raises is tried up to ``retries``
    times more. A late, failed or malformed answer becomes a failure row; nothing is dropped.
    """
    if not 1 <= batch <= MAX_BATCH:
        raise ValueError(f"batch must be between 1 and {MAX_BATCH}")
    asked = decision_payload(df.where("uncertain"))
    extra = [T.StructField("http_status", T.IntegerType()),
             T.StructField("response", T.StringType()),
             T.StructField("error", T.StringType()),
             T.StructField("processed_at_epoch_ms", T.LongType())]
    kept = [f for f in asked.schema.fields if f.name != "processed_at_epoch_ms"]
    asked = asked.select(*[f.name for f in kept])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = _Window(call, timeout_s, retries)
        for part in parts:
            for i in range(0, len(part), batch):
                while len(window.open) >= concurrency:
                    yield from window.next()
                window.send(part.iloc[i:i + batch])
        while window.open:
            yield from window.next()

    answered = asked.mapInPandas(run, T.StructType(kept + extra))
    return decision_result(answered).drop("payload", "http_status", "response", "error")


def _answer(chunk: pd.DataFrame, replies: list | None, problem: BaseException | None
            ) -> pd.DataFrame:
    n = len(chunk)
    status, body, error = [None] * n, [None] * n, [None] * n
    if isinstance(problem, TimeoutError):
        error = ["TIMEOUT"] * n
    elif isinstance(problem, ConnectionError):
        error = [_message("FAILED", problem)] * n
    elif problem is not None:
        error = [_message("REQUEST_ERROR", problem)] * n
    else:
        try:
            if len(replies) != n:
                error = [f"INVALID_RESPONSE:{len(replies)} answers for {n} requests"] * n
            else:
                status, body = (list(x) for x in zip(*replies))
        except Exception as odd:
            error = [_message("REQUEST_ERROR", odd)] * n
    out = chunk.copy()
    out["http_status"] = pd.array(status, dtype="Int32")
    out["response"], out["error"] = body, error
    out["processed_at_epoch_ms"] = int(time.time() * 1000)
    return out
