"""Replication bookkeeping: sequences, times, what to fetch next, how far behind."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Position:
    base_url: str
    sequence: int
    timestamp: datetime


def init(server: Callable[[], Position], find: Callable[[datetime], int], last: datetime, rollback: timedelta = timedelta(minutes=180)) -> Position:
    """Start a little before the last object's time; ``find`` gives the sequence at a time."""
    at = last - rollback
    return replace(server(), sequence=find(at), timestamp=at)


def update(position: Position, server: Callable[[], Position], apply: Callable[[int], datetime], store: Callable[[Position], None],
           per_round: int = 1, once: bool = False, post: Callable[[], None] | None = None) -> Position:
    """Apply the differences that follow, a few a round. The position is stored after a round succeeded, not before."""
    while position.sequence < server().sequence:
        end, at = min(position.sequence + per_round, server().sequence), position.timestamp
        for n in range(position.sequence + 1, end + 1):
            at = apply(n)
        position = replace(position, sequence=end, timestamp=at)
        store(position)
        if post:
            post()
        if once:
            break
    return position


def status(position: Position | None, server: Position | None, now: datetime | None = None) -> dict:
    """0 fine; 1 server not reached; 2 no position; 3 behind in sequences is told beside."""
    if position is None:
        return {"status": 2, "error": "replication was not set up"}
    if server is None:
        return {"status": 1, "error": "server not reached"}
    now = now or datetime.now(UTC)
    return {"status": 0, "server": {"base_url": server.base_url, "sequence": server.sequence, "timestamp": iso(server.timestamp), "age_sec": int((now - server.timestamp).total_seconds())},
            "local": {"sequence": position.sequence, "timestamp": iso(position.timestamp), "age_sec": int((now - position.timestamp).total_seconds())},
            "lag": server.sequence - position.sequence}


def iso(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_time(text: str) -> datetime:
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d))?Z?)?", text)
    if not m:
        raise ValueError(f"no time: {text!r}")
    return datetime(*(int(v or 0) for v in m.groups()), tzinfo=UTC)


def sequence_at(sequences: DataFrame, time) -> DataFrame:
    """The last sequence (seq, ts) not after a time, one row."""
    return sequences.where(F.col("ts") <= time).agg(F.max("seq").alias("seq"))


def check_properties(stored: dict[str, str], options: dict[str, str]) -> list[str]:
    """Why an update can't go on with these options, if it can't."""
    out = []
    if stored.get("updatable", "false") != "true":
        out.append("the import was not made for updates")
    if stored.get("attributes", "false") == "false" and options.get("attributes") == "true":
        out.append("attributes were not stored")
    for key in ("prefix", "flat_node_file", "db_format", "output", "style"):
        if key in options and stored.get(key, "") != options[key]:
            out.append(f"{key}: stored {stored.get(key, '')!r}, given {options[key]!r}")
    return out
