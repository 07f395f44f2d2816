"""Watching files: changes as events, gathered, each answered with a new profile."""

from __future__ import annotations

import glob
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import profile

SHORTEST, DEBOUNCE_MS = 0.01, 500


@dataclass(frozen=True)
class WatchEvent:
    paths: tuple[Path, ...]
    at: float


@dataclass
class WatchLoopStats:
    renders: int = 0
    events: int = 0
    errors: int = 0


def targets(patterns: Iterable[str]) -> list[Path]:
    """Files for paths, folders and globs, each once."""
    found: dict[Path, Path] = {}
    for pattern in patterns:
        if any(c in pattern for c in "*?["):
            paths = map(Path, sorted(glob.glob(pattern, recursive=True)))
        elif Path(pattern).is_dir():
            paths = sorted(p for p in Path(pattern).iterdir() if p.is_file())
        else:
            paths = [Path(pattern)]
        for p in paths:
            found.setdefault(p.resolve(), p)
    return list(found.values())


def snapshot(paths: Iterable[Path]) -> dict[Path, tuple[float, int] | None]:
    out: dict[Path, tuple[float, int] | None] = {}
    for p in paths:
        try:
            stat = p.stat()
            out[p] = stat.st_mtime, stat.st_size
        except OSError:
            out[p] = None
    return out


def polled(list_paths: Callable[[], list[Path]], interval: float = 1.0, *, clock=time.monotonic, sleep=time.sleep, rounds: int | None = None) -> Iterator[WatchEvent]:
    """An event whenever times or sizes have changed between two looks, and for files that come or go."""
    seen = snapshot(list_paths())
    while rounds is None or rounds > 0:
        sleep(max(interval, SHORTEST))
        now = snapshot(list_paths())
        gone = [p for p, state in seen.items() if state is not None and p not in now]
        changed = (*(p for p, state in now.items() if seen.get(p) != state), *gone)
        seen = now
        if changed:
            yield WatchEvent(changed, clock())
        rounds = None if rounds is None else rounds - 1


def debounced(events: Iterable[WatchEvent], ms: int = DEBOUNCE_MS) -> Iterator[WatchEvent]:
    """Events within ``ms`` of the last one let through are held and join the next; what is held at the end comes out."""
    if ms < 0:
        raise ValueError("debounce must not be negative")
    last: float | None = None
    held: dict[Path, None] = {}
    at = 0.0
    for event in events:
        held |= dict.fromkeys(event.paths)
        at = event.at
        if last is None or (at - last) * 1000 >= ms:
            last = at
            yield WatchEvent(tuple(held), at)
            held = {}
    if held:
        yield WatchEvent(tuple(held), at)


def watch(events: Iterable[WatchEvent], render: Callable[[Path], None], first: Iterable[Path] = (), on_error: Callable[[Path, Exception], None] = lambda *_: None) -> WatchLoopStats:
    """Render each of ``first``, then whatever changes. An error is counted and told, and the loop goes on."""
    stats = WatchLoopStats()

    def attempt(path: Path) -> None:
        try:
            render(path)
            stats.renders += 1
        except Exception as e:  # a file may be half written or gone
            stats.errors += 1
            on_error(path, e)

    for path in first:
        attempt(path)
    for event in events:
        stats.events += 1
        for path in event.paths:
            attempt(path)
    return stats


def stream_profiles(spark: SparkSession, folder: str, schema, tell: Callable[[int, object], None], form: str = "parquet"):
    """A profile of each batch of new files in a folder, by Structured Streaming. An addition of this library: it sees
    files that come, not files that change."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            tell(number, profile(batch, timeseries_=False))
        finally:
            batch.unpersist()

    return spark.readStream.schema(schema).format(form).load(folder).writeStream.foreachBatch(each)
