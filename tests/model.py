"""A one-pass reader of log lines, as plain Python: what the Spark forms are held against."""

from __future__ import annotations

from logweft.functions.timestamps import timestamp_of


def assemble(lines: list[str]) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    for line in lines:
        ts = timestamp_of(line.encode())
        if ts is not None:
            out.append((ts, line))
        elif out:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + line)
    return out


def one_pass(lines: list[str], start: int, end: int) -> list[tuple[int, str]]:
    """Early headers are dropped without closing the open record."""
    out: list[tuple[int, str]] = []
    now: tuple[int, str] | None = None
    for line in lines:
        ts = timestamp_of(line.encode())
        if ts is None:
            if now is not None:
                now = (now[0], now[1] + "\n" + line)
        elif ts >= start:
            if now is not None:
                out.append(now)
            now = (ts, line) if ts <= end else None
    return out + ([now] if now is not None else [])


def index(lines: list[str], interval: int = 300, force: int = 50_000) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    at = since = 0
    last = end = None
    for line in lines:
        ts = timestamp_of(line.encode())
        if ts is not None:
            bucket = ts - ts % interval
            if last is None or bucket >= last + interval or since >= force:
                out.append((bucket, at))
                last, since = bucket, 0
            since += 1
            end = (ts, at)
        at += len(line.encode()) + 1
    return out + ([end] if end else [])
