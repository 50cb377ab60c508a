"""Leases: one writer a table at a time, with a fencing token that the store checks when it publishes.

Grants are numbered documents beside the table's pointers; the next one is created only if its number is free.  A renewal keeps its token, a
takeover of an expired lease gets a greater one, so a writer that lost its lease without noticing cannot publish after its successor has.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from tidelog.sources.store import TableStore


@dataclass(frozen=True)
class Lease:
    owner: str
    token: int
    expires: float


def current(store: TableStore) -> Lease | None:
    """The last grant, expired or not."""
    numbers = store._numbers("lease")
    return Lease(**store.load(f"lease/{numbers[-1]:012d}.json")) if numbers else None


def acquire(store: TableStore, owner: str, seconds: float, now: float | None = None) -> Lease | None:
    """A new or renewed lease, which the store then publishes under; None if another owner holds it or was faster."""
    now = time.time() if now is None else now
    numbers, last = store._numbers("lease"), current(store)
    live = last is not None and last.expires > now
    if live and last.owner != owner:
        return None
    token = last.token if live else (last.token if last else 0) + 1
    lease = Lease(owner, token, now + seconds)
    if not store.create(f"lease/{(numbers[-1] if numbers else 0) + 1:012d}.json", vars(lease)):
        return None
    store.token = token
    return lease


def release(store: TableStore, lease: Lease, now: float | None = None) -> bool:
    """Let a lease end now; false if it is no longer the current one."""
    now = time.time() if now is None else now
    last = current(store)
    if last is None or (last.owner, last.token) != (lease.owner, lease.token):
        return False
    return store.create(f"lease/{store._numbers('lease')[-1] + 1:012d}.json", vars(Lease(lease.owner, lease.token, now)))
