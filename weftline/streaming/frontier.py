"""The crawl frontier as an ordered fold over its operation log.

A frontier is one sequence of operations for each namespace: admit and merge, claim by priority under politeness, heartbeat,
complete, fail with back-off, defer, recover expired leases. ``Frontier`` is that state machine; ``simulate`` replays logs,
one namespace at a time, as a grouped fold. Namespaces are the unit of parallel work: inside one, order is the meaning.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

QUEUES = ("http", "browser")


@dataclass
class Settings:
    interval: float = 1.0  # seconds between claims on one domain; 0 for none
    in_flight: int = 0  # leases of one domain at a time; 0 for no limit
    lease: float = 60.0
    max_attempts: int = 3
    backoff_base: float = 10.0
    backoff_cap: float = 600.0
    max_depth: int = 1_000_000
    dead_ttl: float = 7 * 86400.0
    dead_max: int = 10_000


@dataclass
class Task:
    domain: str
    queue: str
    priority: int
    state: str = "ready"  # ready, scheduled, leased or dead
    order: int = 0
    attempts: int = 0
    due: float = 0.0
    token: str | None = None
    expires: float = 0.0
    error: str | None = None
    born: int = 0  # place among admissions, for ties


class Order:
    """A heap whose entries may have gone stale: ``holds(entry)`` says whether one still counts."""

    def __init__(self, holds):
        self.heap: list[tuple] = []
        self.holds = holds

    def push(self, *entry) -> None:
        heappush(self.heap, entry)

    def top(self) -> tuple | None:
        while self.heap and not self.holds(self.heap[0]):
            heappop(self.heap)
        return self.heap[0] if self.heap else None

    def until(self, now: float) -> list[tuple]:
        """Entries that count and whose first value is ``now`` or less, taken out in order, each once."""
        out: dict[tuple, None] = {}
        while (entry := self.top()) is not None and entry[0] <= now:
            out[heappop(self.heap)] = None
        return list(out)


@dataclass
class Frontier:
    """Claims take the logarithm of what waits: each queue orders the best ready task of each domain, and a domain that may
    not be claimed from leaves that order until its gate, yield or lease ends."""

    settings: Settings = field(default_factory=Settings)
    tasks: dict[str, Task] = field(default_factory=dict)
    gates: dict[str, tuple[float, str]] = field(default_factory=dict)  # domain -> closed until, queue that claimed
    yields: dict[tuple[str, str], float] = field(default_factory=dict)  # a queue lets others go first
    sequence: int = 0
    closings: int = 0
    admissions: int = 0

    def __post_init__(self) -> None:
        self.waiting: dict[tuple[str, str], Order] = {}  # ready tasks by queue and domain: (-priority, order, key)
        self.ready: Counter = Counter()  # their number
        self.depths: Counter = Counter()  # tasks of a queue that are not dead
        self.leased: Counter = Counter()  # by domain
        self.dead: set[str] = set()
        self.heads = {q: Order(lambda e, q=q: self._waits(q, e[3], e)) for q in QUEUES}
        self.scheduled = Order(lambda e: self._is(e[3], "scheduled") and (self.tasks[e[3]].due, self.tasks[e[3]].order) == e[:2])
        self.leases = Order(lambda e: self._is(e[2], "leased") and (self.tasks[e[2]].expires, self.tasks[e[2]].order) == e[:2])
        self.opening = Order(lambda e: self.gates.get(e[3], (None,))[0] == e[0])
        self.yielding = Order(lambda e: self.yields.get(e[1:]) == e[0])

    def _is(self, key: str, state: str) -> bool:
        task = self.tasks.get(key)
        return task is not None and task.state == state

    def _waits(self, queue: str, domain: str, entry: tuple) -> bool:
        task = self.tasks.get(entry[2])
        return task is not None and task.state == "ready" and (task.queue, task.domain, -task.priority, task.order) == (queue, domain, *entry[:2])

    def _leave(self, key: str) -> None:
        """Take a task out of the counts of its state and queue."""
        task = self.tasks[key]
        if task.state == "ready":
            self.ready[task.queue, task.domain] -= 1
        elif task.state == "leased":
            self.leased[task.domain] -= 1
            self._offer_all(task.domain)
        self.dead.discard(key)
        self.depths[task.queue] -= task.state != "dead"

    def _enter(self, key: str, task: Task, state: str) -> None:
        self.tasks[key] = task
        task.state = state
        self.depths[task.queue] += state != "dead"
        if state == "ready":
            self.ready[task.queue, task.domain] += 1
        elif state == "leased":
            self.leased[task.domain] += 1
        elif state == "dead":
            self.dead.add(key)

    def _drop(self, key: str) -> None:
        task = self.tasks[key]
        self._leave(key)
        task.state = "gone"
        del self.tasks[key]

    def _wait(self, key: str, task: Task) -> None:
        place = (task.queue, task.domain)
        if place not in self.waiting:
            self.waiting[place] = Order(lambda e, p=place: self._waits(*p, e))
        self.waiting[place].push(-task.priority, task.order, key)
        self._offer(*place)

    def _offer(self, queue: str, domain: str) -> None:
        """Put the best ready task of a domain in its queue's order."""
        order = self.waiting.get((queue, domain))
        if order is not None and (best := order.top()) is not None and not self._closed(queue, domain):
            self.heads.setdefault(queue, Order(lambda e, q=queue: self._waits(q, e[3], e))).push(*best, domain)

    def _offer_all(self, domain: str) -> None:
        for queue in {*QUEUES, *self.heads}:
            self._offer(queue, domain)

    def _closed(self, queue: str, domain: str) -> bool:
        full = self.settings.in_flight and self.leased[domain] >= self.settings.in_flight
        return bool(full) or domain in self.gates or (queue, domain) in self.yields

    def _ready(self, key: str, task: Task) -> None:
        self.sequence += 1
        task.order, task.token = self.sequence, None
        self._enter(key, task, "ready")
        self._wait(key, task)

    def _later(self, key: str, task: Task, due: float) -> None:
        task.due, task.token = due, None
        self._enter(key, task, "scheduled")
        self.scheduled.push(due, task.order, task.born, key)

    def depth(self, queue: str) -> int:
        return self.depths[queue]

    def advance(self, now: float) -> None:
        """What is due by now: scheduled tasks become ready, gates and yields open."""
        for *_, key in self.scheduled.until(now):
            self._leave(key)
            self._ready(key, self.tasks[key])
        for _, queue, _, domain in self.opening.until(now):
            del self.gates[domain]
            others = any(n > 0 for (q, d), n in ((p, self.ready[p]) for p in ((q, domain) for q in self.heads)) if q != queue)
            if self.ready[queue, domain] > 0 and others:
                self.yields[queue, domain] = now + self.settings.interval
                self.yielding.push(now + self.settings.interval, queue, domain)
            self._offer_all(domain)
        for _, queue, domain in self.yielding.until(now):
            del self.yields[queue, domain]
            self._offer(queue, domain)

    def admit(self, now: float, key: str, domain: str, queue: str, priority: int, due: float | None = None) -> str:
        """One task for each URL: the higher priority wins, and a task never tried may move earlier."""
        due = now if due is None else due
        task = self.tasks.get(key)
        if task is not None and task.state != "dead":
            changed = False
            if task.state in ("ready", "scheduled") and priority > task.priority:
                task.priority, changed = priority, True
                if task.state == "ready":
                    self._wait(key, task)
            if task.state == "scheduled" and due < task.due and task.attempts == 0:
                task.due, changed = due, True
                self.scheduled.push(due, task.order, task.born, key)
            return "merged" if changed else "duplicate"
        if self.depth(queue) >= self.settings.max_depth:
            return "rejected_full"
        if task is not None:
            self._drop(key)
        self.admissions += 1
        task = Task(domain, queue, priority, born=self.admissions)
        if due > now:
            self._later(key, task, due)
            return "scheduled"
        self._ready(key, task)
        return "ready"

    def claim(self, now: float, queue: str, token: str) -> str | None:
        """The best ready task of a domain that is open, not yielding and below its limit."""
        self.advance(now)
        heads = self.heads.setdefault(queue, Order(lambda e, q=queue: self._waits(q, e[3], e)))
        while (best := heads.top()) is not None:
            heappop(heads.heap)
            key, domain = best[2:]
            if self._closed(queue, domain):
                continue  # it is offered again when it opens
            task = self.tasks[key]
            if self.settings.interval > 0:
                until = now + self.settings.interval
                self.closings += 1
                self.gates[domain] = (until, queue)
                self.opening.push(until, queue, self.closings, domain)
                for q in {*QUEUES, *self.heads}:
                    self.yields.pop((q, domain), None)
            self._leave(key)
            task.token, task.expires, task.attempts = token, now + self.settings.lease, task.attempts + 1
            self._enter(key, task, "leased")
            self.leases.push(task.expires, task.order, key)
            self._offer_all(domain)
            return key
        return None

    def _own(self, key: str, token: str) -> Task | None:
        task = self.tasks.get(key)
        return task if task is not None and task.state == "leased" and task.token == token else None

    def heartbeat(self, now: float, key: str, token: str) -> str:
        if (task := self._own(key, token)) is None:
            return "stale"
        task.expires = now + self.settings.lease
        self.leases.push(task.expires, task.order, key)
        return "extended"

    def complete(self, now: float, key: str, token: str) -> str:
        if self._own(key, token) is None:
            return "stale"
        self._drop(key)
        return "completed"

    def backoff(self, attempts: int) -> float:
        return min(self.settings.backoff_cap, self.settings.backoff_base * 2 ** (attempts - 1))

    def fail(self, now: float, key: str, token: str, reason: str = "", next_queue: str | None = None) -> str:
        if (task := self._own(key, token)) is None:
            return "stale"
        if task.attempts >= self.settings.max_attempts:
            self._drop(key)
            return "exhausted"
        self._leave(key)
        task.queue, task.error = next_queue or task.queue, reason
        self._later(key, task, now + self.backoff(task.attempts))
        return "retry_scheduled"

    def defer(self, now: float, key: str, token: str, delay: float) -> str:
        """Back to the schedule without using an attempt."""
        if (task := self._own(key, token)) is None:
            return "stale"
        task.attempts -= 1
        self._leave(key)
        self._later(key, task, now + delay)
        return "deferred"

    def recover(self, now: float) -> tuple[int, int]:
        """(recovered, dead): expired leases go back with back-off; those without attempts left become dead letters,
        which expire and are bounded, the oldest first."""
        self.advance(now)
        recovered = dead = 0
        for _, _, key in self.leases.until(now):
            task = self.tasks[key]
            self._leave(key)
            task.error = "lease expired"
            if task.attempts < self.settings.max_attempts:
                self._later(key, task, now + self.backoff(task.attempts))
                recovered += 1
            else:
                task.due, task.token = now, None
                self._enter(key, task, "dead")
                dead += 1
        letters = sorted((self.tasks[k].due, k) for k in self.dead)
        surplus = max(0, len(letters) - self.settings.dead_max)
        for k, (at, key) in enumerate(letters):
            if k < surplus or at + self.settings.dead_ttl <= now:
                self._drop(key)
        return recovered, dead

    def violations(self, now: float) -> list[str]:
        """Consistency: every task in one valid state, limits held, no ready work of an open domain forgotten."""
        out = [f"{k}: no such state" for k, t in self.tasks.items() if t.state not in ("ready", "scheduled", "leased", "dead")]
        out += [f"{k}: lease without a token" for k, t in self.tasks.items() if (t.state == "leased") != (t.token is not None)]
        held = Counter(t.domain for t in self.tasks.values() if t.state == "leased")
        out += [f"{d}: over its limit" for d, n in held.items() if 0 < self.settings.in_flight < n]
        out += ["counts differ"] * (held != +self.leased or Counter(t.queue for t in self.tasks.values() if t.state != "dead") != +self.depths)
        orders = [t.order for t in self.tasks.values() if t.state == "ready"]
        return out + ["two ready tasks have one place"] * (len(orders) != len(set(orders)))


LOG = "namespace string, seq long, now double, op string, key string, domain string, queue string, priority int, token string, value double"
RESULT = "namespace string, seq long, op string, key string, result string"


def simulate(log: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The result of each operation of a log (LOG), in the order of ``seq`` inside each namespace."""
    settings = settings or Settings()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        f, out = Frontier(settings), []
        for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
            value = None if r.value != r.value else r.value
            key, result = r.key, None
            if r.op == "admit":
                result = f.admit(r.now, r.key, r.domain, r.queue, int(r.priority), value)
            elif r.op == "claim":
                key = f.claim(r.now, r.queue, r.token)
                result = "claimed" if key else "none"
            elif r.op == "recover":
                result = "{}/{}".format(*f.recover(r.now))
            elif r.op == "defer":
                result = f.defer(r.now, r.key, r.token, value or 0.0)
            elif r.op in ("heartbeat", "complete", "fail"):
                result = getattr(f, r.op)(r.now, r.key, r.token)
            else:
                result = "unknown operation"
            out.append((r.namespace, r.seq, r.op, key, result))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return log.groupBy("namespace").applyInPandas(run, RESULT)
