"""Feeds as a stream that asks only for what has changed.

The offset of the stream is the number of the poll and, for each feed, the validators of the body it last sent (ETag and
Last-Modified) and the last status. The driver only compares validators; bodies are read by tasks, one for each feed
where a single poll is due. A stream that is behind takes many polls in a batch, MOST answers or so; polls that
nothing answered are passed over. A poll gives one row for each feed: with the body where it has changed, marked `not_modified` (304) where it hasn't, or
with an error (400 and above, or a failed call), which keeps the validators. Offsets are in the stream's checkpoint, so a
restarted stream repeats no body and skips none.

What asks is a `Poller`: `Landed` replays a table of landed responses; another is named by the option `poller`
as `module:Class` and gets the options.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


#: Answers after which a batch takes no more polls, polls of a batch, its tasks, and answers of a task that reads many bodies at once.
MOST, MOST_POLLS, TASKS, SHARE = 20_000, 1000, 64, 2500


class Answer(NamedTuple):
    """What a feed says of itself, without its body."""

    status: int
    etag: str | None = None
    last_modified: str | None = None
    error: str | None = None


class Poller(Protocol):
    def feeds(self) -> list[str]: ...

    def ask(self, poll: int, state: dict[str, Answer]) -> dict[str, Answer] | None:
        """Answers of poll `poll` (from 1), given the validators of each feed; None if it isn't due. Called by the driver."""

    def body(self, poll: int, feed: str) -> str:
        """The body behind that answer. Called by a task.

        A poller may also have, as Landed has, `bodies`, which reads many at once, and `following`, the next poll to ask after one.
        """


class Landed:
    """Replays responses (feed, poll, status, etag, last_modified, body): a folder of Parquet files in `responses`, of any file system Arrow knows."""

    COLUMNS = ("feed", "poll", "status", "etag", "last_modified")

    def __init__(self, options: dict[str, str]):
        self.uri = options["responses"]
        self.known: dict[int, dict[str, Answer]] = {}
        self.read: range = range(0)
        self.due: np.ndarray | None = None

    def _batches(self, columns: list[str], first: int | None = None, last: int | None = None):
        """Rows of those polls, some at a time."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        among = None if first is None else (pc.field("poll") >= first) & (pc.field("poll") <= last)
        yield from ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=columns, filter=among, batch_size=1024, batch_readahead=2, fragment_readahead=1)

    def _due(self) -> np.ndarray:
        """The polls that have answers, ascending."""
        if self.due is None:
            due = np.zeros(0, np.int64)
            for b in self._batches(["poll"]):
                due = np.union1d(due, b.column(0).drop_null().to_numpy())
            self.due = due
        return self.due

    def following(self, poll: int) -> int:
        """The next poll after that one that has answers."""
        at = np.searchsorted(self._due(), poll, side="right")
        return int(self._due()[at]) if at < len(self._due()) else poll + 1

    def _answers(self, poll: int) -> dict[str, Answer]:
        """Of one poll; those of MOST_POLLS polls are kept at a time."""
        if poll not in self.read:
            at = np.searchsorted(self._due(), poll)
            last = int(self._due()[at : at + MOST_POLLS][-1])
            self.known, self.read = {}, range(poll, last + 1)
            for b in self._batches(list(self.COLUMNS), poll, last):
                for r in b.to_pylist():
                    self.known.setdefault(r["poll"], {})[r["feed"]] = Answer(r["status"], r["etag"], r["last_modified"])
        return self.known.get(poll, {})

    def feeds(self) -> list[str]:
        return sorted({f for b in self._batches(["feed"]) for f in b.column(0).unique().to_pylist()})

    def ask(self, poll: int, state: dict[str, Answer]) -> dict[str, Answer] | None:
        """Like a server: 304 to validators that still hold."""
        if not len(self._due()) or poll > self._due()[-1]:
            return None
        out = {}
        for feed, now in self._answers(poll).items():
            had = state.get(feed)
            same = had is not None and now.status == 200 and ((now.etag and now.etag == had.etag) or (not now.etag and now.last_modified and now.last_modified == had.last_modified))
            out[feed] = Answer(304, had.etag, had.last_modified) if same else now
        return out

    def body(self, poll: int, feed: str) -> str:
        return dict(self.bodies({(poll, feed)}))[poll, feed]

    def bodies(self, asked: set[tuple[int, str]]) -> Iterator[tuple[tuple[int, str], str]]:
        """All bodies asked for, as one pass over their polls comes to them."""
        for b in self._batches(["poll", "feed", "body"], min(p for p, _ in asked), max(p for p, _ in asked)):
            for r in b.to_pylist():
                if (r["poll"], r["feed"]) in asked:
                    yield (r["poll"], r["feed"]), r["body"]


def poller(options: dict[str, str]) -> Poller:
    if "poller" not in options:
        return Landed(options)
    module, name = options["poller"].split(":")
    return getattr(importlib.import_module(module), name)(options)


def after(state: dict[str, Answer], answers: dict[str, Answer]) -> dict[str, Answer]:
    """The state once these answers have come: a body brings new validators, or none; other answers keep the old ones."""
    out = dict(state)
    for feed, a in answers.items():
        old = state.get(feed, Answer(0))
        out[feed] = a if a.status == 200 else Answer(a.status, old.etag, old.last_modified, a.error)
    return out


class _Answers(InputPartition):
    """(poll, feed, answer) for one task."""

    def __init__(self, told: list[tuple[int, str, Answer]]):
        super().__init__(told[0][:2])
        self.told = told


class ConditionalFeeds(DataSource):
    """Streaming source `conditional_feeds`: source, poll, status, etag, last_modified, not_modified, error, body.

    A batch takes the next polls that are due; option `poller` or `responses` says of what.
    """

    @classmethod
    def name(cls) -> str:
        return "conditional_feeds"

    def schema(self) -> str:
        return "source string, poll long, status int, etag string, last_modified string, not_modified boolean, error string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Polls(dict(self.options))


class _Polls(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.poller = poller(options)
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"poll": 0, "feeds": "{}", "answers": "[]"}

    def latestOffset(self) -> dict:
        """Asks the next polls that are due once the last ones are taken; the same offset again while none is."""
        at = self.at or self.initialOffset()
        poll, polls, told = at["poll"], 0, []
        following = getattr(self.poller, "following", lambda poll: poll + 1)
        state = {f: Answer(*a) for f, a in json.loads(at["feeds"]).items()}
        while len(told) < MOST and polls < MOST_POLLS and (answers := self.poller.ask(following(poll), state)) is not None:
            poll, polls = following(poll), polls + 1
            state = after(state, answers)
            told += [(poll, f, a) for f, a in sorted(answers.items())]
        if poll > at["poll"]:
            at = {"poll": poll, "feeds": json.dumps(state, sort_keys=True), "answers": json.dumps(told)}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Even shares of the answers, in the order of their polls; a batch never spans two offsets, as each is one."""
        self.at = end  # a restarted stream goes on from here
        told = [(poll, feed, Answer(*a)) for poll, feed, a in json.loads(end["answers"])]
        share = max(-(-len(told) // TASKS), SHARE if hasattr(self.poller, "bodies") else 1)
        return [_Answers(told[i : i + share]) for i in range(0, len(told), share)]

    def _bodies(self, asked: set[tuple[int, str]]) -> Iterator[tuple[tuple[int, str], str | None, str | None]]:
        """Each asked key with its body or the error."""
        failed = lambda e: f"{type(e).__name__}: {e}"
        if hasattr(self.poller, "bodies"):
            left, error = set(asked), "LookupError: no body"
            try:
                for key, body in self.poller.bodies(asked):
                    if key in left:
                        left.remove(key)
                        yield key, body, None
            except (OSError, ValueError, LookupError) as e:
                error = failed(e)
            yield from ((key, None, error) for key in sorted(left))
            return
        for key in sorted(asked):
            try:
                yield key, self.poller.body(*key), None
            except (OSError, ValueError, LookupError) as e:
                yield key, None, failed(e)

    def read(self, partition: _Answers) -> Iterator[tuple]:
        row = lambda poll, feed, a, error, body: (feed, poll, a.status, a.etag, a.last_modified, a.status == 304, error, body)
        changed = {(poll, feed): a for poll, feed, a in partition.told if a.status == 200}
        for poll, feed, a in partition.told:
            if a.status != 200:
                yield row(poll, feed, a, a.error or (f"HTTP {a.status}" if a.status >= 400 else None), None)
        if changed:
            for key, body, error in self._bodies(set(changed)):
                yield row(*key, changed[key], error or changed[key].error, body)

    def commit(self, end: dict) -> None:
        self.at = end


def validators(answers: DataFrame) -> DataFrame:
    """feed, etag, last_modified, status: what to send with the next request, from all rows of the stream so far."""
    told = F.max_by(F.struct("etag", "last_modified"), F.when(F.col("status") == 200, F.col("poll")))
    last = F.max_by("status", "poll")
    return answers.groupBy(F.col("source").alias("feed")).agg(told.alias("v"), last.alias("status")).select("feed", "v.etag", "v.last_modified", "status")
