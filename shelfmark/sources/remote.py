"""Requests that tasks make: repeated where that may help, several at once but no more than allowed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import TypeVar

from .services import Post, ServiceError, post

A, B = TypeVar("A"), TypeVar("B")

#: Statuses after which the same request may succeed.
PASSING = frozenset([408, 425, 429, 500, 502, 503, 504])


@dataclass(frozen=True)
class Reply:
    """status and text of the last attempt; error is blank unless there was no answer at all."""

    status: int | None
    text: str
    attempts: int
    error: str


@dataclass(frozen=True)
class Caller:
    """How one service is asked. wait: seconds before the second attempt, doubled for each further one."""

    endpoint: str
    token: str = ""
    timeout: float = 15.0
    attempts: int = 3
    wait: float = 0.5
    send: Post = post

    def ask(self, body: bytes) -> Reply:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.token.strip()}"}
        reply = Reply(None, "", 0, "no attempt is allowed")
        for n in range(1, self.attempts + 1):
            if n > 1:
                time.sleep(self.wait * 2 ** (n - 2))
            try:
                status, text = self.send(self.endpoint, headers, body, self.timeout)
                reply = Reply(status, text, n, "")
            except ServiceError as e:
                reply = Reply(None, "", n, str(e))
            if reply.status is not None and reply.status not in PASSING:
                break
        return reply


def side_by_side(call: Callable[[A], B], items: Iterable[A], width: int) -> Iterator[tuple[A, B]]:
    """Each item with its call's result, in order; at most `width` calls run at once, and no more than
    `width` results wait."""
    left = iter(items)
    with ThreadPoolExecutor(max(1, width)) as pool:
        while some := list(islice(left, max(1, width))):
            yield from zip(some, pool.map(call, some), strict=True)
