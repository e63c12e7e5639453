"""Paging and page outcomes on a stream: runs of pages without a hole, attempts until a page is settled.

Both hold a few numbers per key in the stream's own state and close a key by an event-time timer when nothing more came for
``silence`` seconds.  Start such streams inside :func:`pagemill.streaming.state.keyed_state`.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pagemill.operators.validate import MAX_ATTEMPTS

# The processors travel with the plan, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM = ["market", "search_term"]
REACHED = "market string, search_term string, page_num int, payload string, ended string, waiting bigint"
OUTCOME = "page string, logged bigint, attempts_used bigint, outcome string, success_attempt bigint, last_error string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[n for n, _ in fields])
    whole = {"int": "Int32", "bigint": "Int64"}
    return frame.astype({n: whole[t] for n, t in fields if t in whole})


class _Silence:
    """One timer a key, moved whenever rows come."""

    def __init__(self, handle, silence_ms: int):
        self.handle, self.silence_ms = handle, silence_ms
        self.due = handle.getValueState("due", "at bigint")

    def move(self, newest_ms: int) -> None:
        due = newest_ms + self.silence_ms
        if self.due.exists():
            before = self.due.get()[0]
            if before >= due:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)
        self.due.update((due,))


# Pages beyond a hole that share one value of the state, and rows of a frame that goes out.
BLOCK, FRAME = 256, 10_000


class PageRun(StatefulProcessor):
    """State of one term: the last page of the run that starts at page 1, whether paging ended there, and the pages beyond a hole.

    Those pages are kept in blocks of neighbours, each read and written at most once a batch; pages that continue the run at
    once are never written.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "last int, ended boolean")
        self.waiting = handle.getMapState("blocks", "block int", "pages int, rows string")
        self.silence = _Silence(handle, self.silence_ms)

    def handleInputRows(self, key, rows, timerValues):
        last, ended = self.run.get() if self.run.exists() else (0, False)
        out, newest, fresh = [], None, {}
        for part in rows:
            latest = int(part["at"].max())
            newest = latest if newest is None else max(newest, latest)
            if ended:
                continue
            part = part[part["page_num"] > last]  # others are repeats, or have no number
            for page, more, payload in zip(part["page_num"].tolist(), part["more"].tolist(), part["payload"].tolist()):
                page = int(page)
                fresh.setdefault(page // BLOCK, {}).setdefault(page, (bool(more), payload))
        ahead = sorted(fresh, reverse=True)
        while ahead and not ended:
            block = ahead.pop()
            stored = self.waiting.containsKey((block,))
            pages = fresh.pop(block, {})
            if stored:
                pages.update((page, (more, payload)) for page, more, payload in json.loads(self.waiting.getValue((block,))[1]))
            while not ended and last + 1 in pages:
                last += 1
                more, payload = pages.pop(last)
                out.append((*key, last, payload, None, None))
                ended = not more
            if pages:
                rows_ = json.dumps([(page, *row) for page, row in pages.items()], ensure_ascii=False)
                self.waiting.updateValue((block,), (len(pages), rows_))
            elif stored:
                self.waiting.removeKey((block,))
            # the run went on to a block of which nothing came now
            if (last + 1) // BLOCK == block + 1 and block + 1 not in fresh and self.waiting.containsKey((block + 1,)):
                ahead.append(block + 1)
            if len(out) >= FRAME:
                yield _frame(out, REACHED)
                out = []
        if ended:
            self.waiting.clear()
        self.run.update((last, ended))
        if newest is not None:
            self.silence.move(newest)
        yield _frame(out, REACHED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, ended = self.run.get()
        waiting = sum(pages for pages, _ in self.waiting.values())
        how = "last page" if ended else "hole" if waiting else "silent"
        for state in (self.run, self.waiting, self.silence.due):
            state.clear()
        yield _frame([(*key, last, None, how, waiting)], REACHED)

    def close(self) -> None:
        pass


def reached_stream(facts: DataFrame, silence: int = 86400, delay: str = "1 day") -> DataFrame:
    """Search pages (market, search_term, page_num, captured_at, n_links, has_next, any others) in any order -> those that
    paging gets to, each as soon as no page before it is missing.

    Rows with ``ended`` close a term after ``silence`` seconds without a page: ``page_num`` is its last page (0: none), ``waiting``
    the pages that were never reached; ``ended`` is 'last page' (a page without links or without a next one), 'hole' (an earlier
    page never came) or 'silent'.  After that the term's state is gone.  Repeats of a page, pages below 1 and pages without a
    number or a time are left out.
    """
    rest = [c for c in facts.columns if c not in (*TERM, "page_num")]
    fields = T.StructType([facts.schema[c] for c in rest])
    more = F.coalesce(F.col("has_next") & (F.col("n_links") > 0), F.lit(False))
    rows = facts.where("page_num >= 1 and captured_at is not null").withWatermark("captured_at", delay).select(
        *TERM, F.col("page_num").cast("int").alias("page_num"), more.alias("more"),
        F.to_json(F.struct(*rest)).alias("payload"), F.unix_millis("captured_at").alias("at"), "captured_at")
    done = rows.groupBy(*TERM).transformWithStateInPandas(PageRun(1000 * silence), REACHED, "Append", "EventTime")
    return done.withColumn("_row", F.from_json("payload", fields)).select(
        *TERM, "page_num", *[F.col("_row")[c].alias(c) for c in rest], "ended", "waiting")


class Attempts(StatefulProcessor):
    """State of one page: least successful and final attempt, greatest attempt, the last error, and how many were logged."""

    def __init__(self, silence_ms: int, max_attempts: int):
        self.silence_ms, self.max_attempts = silence_ms, max_attempts

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "logged bigint, good bigint, final bigint, last bigint, failed bigint, error string")
        self.silence = _Silence(handle, self.silence_ms)

    def handleInputRows(self, key, rows, timerValues):
        logged, good, final, last, failed, error = self.seen.get() if self.seen.exists() else (0, None, None, 0, None, None)
        newest = None
        for part in rows:
            for n, kind, message, at in part[["attempt", "attempt_class", "error", "at"]].itertuples(index=False, name=None):
                n, newest = int(n), int(at) if newest is None else max(newest, int(at))
                logged, last = logged + 1, max(last, n)
                if kind == "success":
                    good = n if good is None else min(good, n)
                elif kind == "final":
                    final = n if final is None else min(final, n)
                if isinstance(message, str) and n <= self.max_attempts and (failed is None or n > failed):
                    failed, error = n, message
        self.seen.update((logged, good, final, last, failed, error))
        if newest is not None:
            self.silence.move(newest)
        yield _frame([], OUTCOME)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        logged, good, final, last, _, error = self.seen.get()
        most = self.max_attempts
        if good is not None and good <= most and (final is None or good < final):
            outcome = "success"
        elif final is not None and final <= most:
            outcome = "failed"
        else:
            outcome = "exhausted" if last >= most else "pending"
        used = min(n for n in (good, final, last, most) if n is not None)
        for state in (self.seen, self.silence.due):
            state.clear()
        yield _frame([(*key, logged, used, outcome, good if outcome == "success" else None, error)], OUTCOME)

    def close(self) -> None:
        pass


def outcome_stream(attempts: DataFrame, page: str, silence: int = 86400, delay: str = "1 day",
                   max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Attempts (``page``, attempt, attempt_class, error, captured_at) in any order -> one row a page, as ``capture_outcome``
    gives it, once no attempt came for ``silence`` seconds.

    Attempts without a number or a time are left out.  An attempt later than that opens its page anew.
    """
    rows = attempts.where("attempt is not null and captured_at is not null").withWatermark("captured_at", delay).select(
        F.col(page).cast("string").alias("page"), F.col("attempt").cast("bigint").alias("attempt"), "attempt_class",
        F.col("error").cast("string").alias("error"), F.unix_millis("captured_at").alias("at"), "captured_at")
    done = rows.groupBy("page").transformWithStateInPandas(Attempts(1000 * silence, max_attempts), OUTCOME, "Append", "EventTime")
    return done.withColumn(page, F.col("page").cast(attempts.schema[page].dataType)).select(
        page, *[c for c in done.columns if c != "page"])
