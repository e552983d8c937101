"""What becomes of an item of the queue: one state for each, in a streaming query, with timers for what does not happen.

An item is waiting until its audio is there, then claimed, for one attempt of one worker, until that tells its outcome. Audio that
does not come in time drops the item; an attempt that fails, or whose lease runs out as its worker is gone, is claimed again, up
to ``tries`` times. Every claim has its attempt's number, so a late outcome of an attempt that was given up is told apart. The
state survives restarts; each change is a row: claim, done, failed, dropped, skipped. Every meta file ends in exactly one row other than
a claim, so the queue is worked off when these are as many as the files.

The rules are plain functions of a state and an event (``on_event``, ``on_timer``); ``ItemLives`` holds the state in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ITEM = "show_id string, episode_id string, audio_sha256 string, title string"
#: kind is meta, audio, ok or fail; attempt and reason are those of ok and fail.
EVENTS = f"item string, kind string, {ITEM}, attempt int, reason string"
ACTIONS = f"item string, action string, attempt int, {ITEM}, reason string"
STATE = f"phase string, audio boolean, attempt int, due bigint, {ITEM}"
WAITING, CLAIMED, DONE, FAILED, DROPPED = "waiting", "claimed", "done", "failed", "dropped"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Attempts, and seconds that a claim holds and that audio is waited for; without needs_audio metas are claimed at once."""

    tries: int = 3
    lease: float = 600.0
    patience: float = 60.0
    needs_audio: bool = True


@dataclass(frozen=True)
class Life:
    phase: str = ""
    audio: bool = False
    attempt: int = 0
    due: int = 0  # milliseconds
    show_id: str = ""
    episode_id: str = ""
    audio_sha256: str = ""
    title: str = ""


Step = tuple[Life, tuple[str, str] | None]


def claim(life: Life, now: int, rules: Rules, reason: str = "") -> Step:
    return replace(life, phase=CLAIMED, attempt=life.attempt + 1, due=now + int(rules.lease * 1000)), ("claim", reason)


def again(life: Life, now: int, rules: Rules, reason: str) -> Step:
    """Another attempt, or the end after the last."""
    return claim(life, now, rules, reason) if life.attempt < rules.tries else (replace(life, phase=FAILED, due=0), ("failed", reason))


def on_event(life: Life, e: Row, now: int, rules: Rules) -> Step:
    if e.kind == "meta":
        if life.phase in (WAITING, CLAIMED):
            return life, ("skipped", "in the queue already")
        if life.phase == DONE and life.audio_sha256 == e.audio_sha256:
            return life, ("skipped", "done before")
        fresh = Life(WAITING, life.audio, 0, now + int(rules.patience * 1000), e.show_id, e.episode_id, e.audio_sha256, e.title)
        return claim(fresh, now, rules) if fresh.audio or not rules.needs_audio else (fresh, None)
    if e.kind == "audio":
        heard = replace(life, audio=True)
        return claim(heard, now, rules) if life.phase == WAITING else (heard, None)
    if life.phase != CLAIMED or e.attempt is None or e.attempt > life.attempt:
        return life, None
    if e.kind == "ok":
        return replace(life, phase=DONE, attempt=e.attempt, due=0), ("done", "")
    return again(life, now, rules, e.reason or "failed") if e.attempt == life.attempt else (life, None)


def on_timer(life: Life, now: int, rules: Rules) -> Step:
    if not life.due or now < life.due:
        return life, None
    if life.phase == WAITING:
        return replace(life, phase=DROPPED, due=0), ("dropped", "no audio in time")
    return again(life, now, rules, "lease ran out") if life.phase == CLAIMED else (life, None)


#: Of one batch's events of an item, in this order.
ORDER = {"audio": 0, "meta": 1, "fail": 2, "ok": 3}


class ItemLives(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("life", STATE)

    def held(self) -> Life:
        return Life(*self.state.get()) if self.state.exists() else Life()

    def keep(self, before: Life, life: Life) -> None:
        if life != before:
            self.state.update(astuple(life))
        if life.due and life.due != before.due:
            self.handle.registerTimer(life.due)

    def told(self, item: str, life: Life, what: tuple[str, str]) -> Row:
        return Row(item=item, action=what[0], attempt=life.attempt, show_id=life.show_id, episode_id=life.episode_id, audio_sha256=life.audio_sha256, title=life.title, reason=what[1])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, before = timerValues.getCurrentProcessingTimeInMs(), self.held()
        life = before
        for e in sorted(rows, key=lambda e: (ORDER[e.kind], e.attempt or 0)):
            life, what = on_event(life, e, now, self.rules)
            if what:
                yield self.told(key[0], life, what)
        self.keep(before, life)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.held()
        life, what = on_timer(before, timerValues.getCurrentProcessingTimeInMs(), self.rules)
        self.keep(before, life)
        if what:
            yield self.told(key[0], life, what)

    def close(self) -> None:
        pass


def lives(events: DataFrame, rules: Rules) -> DataFrame:
    """ACTIONS of a stream of EVENTS."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.groupBy("item").transformWithState(ItemLives(rules), ACTIONS, "append", "ProcessingTime")
