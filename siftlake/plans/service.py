"""Requests one after another, and answers kept for a while."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class Kept:
    """Answers by name and parameters, for so many seconds; the order of parameters doesn't matter."""

    def __init__(self, seconds: float = 5.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock, self.held, self.lock = seconds, clock, {}, threading.Lock()

    def get(self, name: str, parameters: dict, make: Callable[[], Any]) -> Any:
        key = f"{name}:{json.dumps(parameters, sort_keys=True, default=str)}"
        with self.lock:
            at = self.held.get(key)
            if at and at[0] > self.clock():
                return at[1]
        value = make()
        with self.lock:
            self.held[key] = (self.clock() + self.seconds, value)
        return value

    def forget(self, name: str = "") -> None:
        with self.lock:
            self.held = {k: v for k, v in self.held.items() if name and not k.startswith(f"{name}:")}


class Confirmations:
    """A place for one confirmation: a writer is refused while it is taken, a reader waits for so many seconds."""

    def __init__(self) -> None:
        self.held: queue.Queue = queue.Queue(maxsize=1)

    def offer(self, value: Any) -> bool:
        try:
            self.held.put_nowait(value)
        except queue.Full:
            return False
        return True

    def poll(self, seconds: float) -> Any | None:
        try:
            return self.held.get(timeout=seconds)
        except queue.Empty:
            return None


@dataclass
class Item:
    """A request in the queue: queued, dispatching, monitoring, completed, failed or cancelled."""

    request_id: str
    work: Callable[[], Any]
    state: str = "queued"
    result: Any = None
    error: str | None = None
    done: threading.Event = field(default_factory=threading.Event)


class Queue:
    """First come, first served, one at a time; a request that waits can be cancelled, one that is worked on can't."""

    def __init__(self) -> None:
        self.waiting: deque[Item] = deque()
        self.items: dict[str, Item] = {}
        self.lock = threading.Lock()
        self.worker: threading.Thread | None = None

    def submit(self, request_id: str, work: Callable[[], Any]) -> Item:
        with self.lock:
            if request_id in self.items:
                raise ValueError(f"request {request_id!r} is there already")
            item = self.items[request_id] = Item(request_id, work)
            self.waiting.append(item)
            if self.worker is None:
                self.worker = threading.Thread(target=self._run, daemon=True)
                self.worker.start()
        return item

    def cancel(self, request_id: str) -> bool:
        with self.lock:
            item = self.items.get(request_id)
            if item is None or item.state != "queued":
                return False
            self.waiting.remove(item)
            item.state = "cancelled"
            item.done.set()
            return True

    def positions(self) -> list[str]:
        with self.lock:
            return [i.request_id for i in self.waiting]

    def _run(self) -> None:
        while True:
            with self.lock:
                if not self.waiting:
                    self.worker = None
                    return
                item = self.waiting.popleft()
                item.state = "monitoring"
            try:
                item.result, item.state = item.work(), "completed"
            except Exception as error:  # the queue goes on; the caller reads the error from the item
                item.state, item.error = "failed", str(error)
            item.done.set()
