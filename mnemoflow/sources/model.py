"""Stage models: calls in flight up to a limit with retries, and deterministic answers."""

from __future__ import annotations

import asyncio
import re
from collections.abc import Awaitable, Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_output import PASSING, PASSING_CODES

_KIND = "key string, response string, attempts int, error string"


class Deterministic:
    """Answers by an expression of the prompt, in the JVM."""

    def __init__(self, answer: Callable[[Column], Column]) -> None:
        self.answer = answer

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("key", self.answer(F.col("prompt")).alias("response"))


class Baked(Deterministic):
    """Gives back the answer that the prompt carries: the deterministic model of each stage (see ``baked``)."""

    def __init__(self) -> None:
        super().__init__(lambda prompt: F.regexp_extract(prompt, f"(?s)^.*\n\n{_FENCE[0]}(.*){_FENCE[1]}$", 1))


_FENCE = ("<ANSWER IS>", "</ANSWER IS>")  # behind a blank line, which JSON on one line can't hold


def baked(answer: Column) -> Column:
    """The end of a prompt that a ``Baked`` model answers."""
    return F.concat(F.lit("\n\n" + _FENCE[0]), answer, F.lit(_FENCE[1]))


class Calls:
    """A model behind an asynchronous function of a prompt, such as a request to a service.

    A task holds ``limit`` calls in flight at most, whatever the number of prompts, and takes further prompts only as
    calls end; answers come as they're ready, told by their key. A fault that passes by itself is tried again, up to
    ``attempts`` times, after a pause that doubles; any other, or the last, leaves a null response and its ``error``.
    ``start`` is called once a task and gives the function.
    """

    def __init__(self, start: Callable[[], Callable[[str], Awaitable[str]]], limit: int = 4, attempts: int = 4, base_ms: int = 500, timeout_s: float = 120.0) -> None:
        if limit < 1 or attempts < 1:
            raise ValueError("limit and attempts must be 1 at least")
        self.start, self.limit, self.attempts, self.base_ms, self.timeout_s = start, limit, attempts, base_ms, timeout_s

    def complete(self, prompts: DataFrame) -> DataFrame:
        """(key, response, attempts, error) of (key, prompt)."""
        start, limit, attempts, base_ms, timeout_s = self.start, self.limit, self.attempts, self.base_ms, self.timeout_s

        async def asked(call, key: str, prompt: str) -> tuple:
            for attempt in range(attempts):
                try:
                    return key, await asyncio.wait_for(call(prompt or ""), timeout_s), attempt + 1, None
                except Exception as e:  # noqa: BLE001 - whatever a client raises is a fault of the call
                    said = "timed out" if isinstance(e, TimeoutError) else str(e)
                    if attempt + 1 == attempts or not passing(said):
                        return key, None, attempt + 1, said
                    await asyncio.sleep(base_ms * 2**attempt / 1000)
            raise AssertionError

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            call, loop, flying = start(), asyncio.new_event_loop(), set()

            def ended(most: int) -> list[tuple]:
                """Waits until no more than ``most`` calls are in flight."""
                nonlocal flying
                out = []
                while len(flying) > most:
                    done, flying = loop.run_until_complete(asyncio.wait(flying, return_when=asyncio.FIRST_COMPLETED))
                    out += [t.result() for t in done]
                return out

            try:
                for batch in batches:
                    for key, prompt in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                        flying.add(loop.create_task(asked(call, key, prompt)))
                        if out := ended(limit - 1):
                            yield _rows(out)
                if out := ended(0):
                    yield _rows(out)
            finally:
                loop.close()

        return prompts.select(F.col("key").cast("string").alias("key"), "prompt").mapInArrow(run, _KIND)


def passing(message: str) -> bool:
    """As ``model_output.transient``."""
    return bool(re.search(PASSING_CODES, message) or re.search(PASSING, message))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [("key", pa.string()), ("response", pa.string()), ("attempts", pa.int32()), ("error", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
