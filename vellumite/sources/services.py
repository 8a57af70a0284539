"""Services that documents come from and go to, as interfaces: their calls, retries and polls. Nothing here opens a connection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol


class Answer(Protocol):
    """What a call returns."""

    status: int
    text: str
    url: str


class Failed(Exception):
    """A service's refusal, with its status where it has one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def retried(call: Callable[[], Answer], retries: int = 2, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The answer of a call that is made again after an error, a 429 or a 5xx, each time after twice as long."""
    for k in range(retries + 1):
        try:
            answer = call()
            if k == retries or not (answer.status == 429 or answer.status >= 500):
                return answer
        except Exception:
            if k == retries:
                raise
        sleep(first * 2**k)
    raise AssertionError


def first_that_answers(addresses: Iterable[str], call: Callable[[str], Answer], spam: Iterable[str] = ()) -> Answer:
    """The first answer below 400 that was not redirected to a known spam address; the last refusal is raised."""
    refused = Failed("no address was given")
    for address in addresses:
        answer = call(address)
        if any(answer.url.startswith(s) for s in spam):
            refused = Failed("redirected to spam", answer.status)
        elif answer.status >= 400:
            refused = Failed(answer.text, answer.status)
        else:
            return answer
    raise refused


class Parser(Protocol):
    """A parser of documents: a batch is asked for, its files are sent, its state is asked until it is done."""

    def submit(self, entries: list[str], options: dict) -> tuple[str, list[str]]: ...
    def send(self, address: str, content: bytes) -> None: ...
    def state(self, batch: str) -> list[dict]: ...


@dataclass
class StubParser:
    """A parser that needs so many questions until it is done; a name with "bad" fails."""

    rounds: int = 2
    sent: dict[str, bytes] = field(default_factory=dict)
    asked: int = 0
    names: list[str] = field(default_factory=list)

    def submit(self, entries: list[str], options: dict) -> tuple[str, list[str]]:
        self.names = list(entries)
        return "batch", [f"put://{n}" for n in entries]

    def send(self, address: str, content: bytes) -> None:
        self.sent[address] = content

    def state(self, batch: str) -> list[dict]:
        self.asked += 1
        done = self.asked >= self.rounds
        return [{"name": n, "state": ("failed" if "bad" in n else "done") if done else "running", "progress": min(100, 100 * self.asked // self.rounds)} for n in self.names]


def parsed(parser: Parser, files: dict[str, bytes], options: dict | None = None, pause: float = 3.0, longest: float = 3600.0, sleep: Callable[[float], None] = time.sleep, told: Callable[[list[dict]], None] = lambda _: None) -> list[dict]:
    """Sends a batch of files and asks for its state, three times where asking fails, until every file is done or failed."""
    batch, addresses = parser.submit(list(files), options or {})
    for address, content in zip(addresses, files.values(), strict=True):
        parser.send(address, content)
    waited = 0.0
    while True:
        for k in range(3):
            try:
                states = parser.state(batch)
                break
            except Exception:
                if k == 2:
                    raise
                sleep(2.0)
        told(states)
        if all(s["state"] in ("done", "failed") for s in states):
            return states
        if waited >= longest:
            raise Failed("the parser did not end in time")
        sleep(pause)
        waited += pause
