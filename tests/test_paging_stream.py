"""Paging and outcomes as keyed state of a stream: rows out of order, closed by silence."""

import datetime

from pagemill.streaming.paging import outcome_stream, reached_stream
from tests.test_stream import stream_of
from pagemill.streaming.state import keyed_state

FACTS = "market string, search_term string, page_num int, captured_at timestamp, n_links bigint, has_next boolean, _row string"
TRIES = "page string, attempt int, attempt_class string, error string, captured_at timestamp"


def at(days):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days)


def collected(spark, tmp_path, schema, steps, build):
    out, last = str(tmp_path / "out"), []

    def run(stream):
        with keyed_state(spark):
            query = (build(stream).writeStream.format("parquet").option("path", out)
                     .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        last.append(query)
        return query

    stream_of(spark, str(tmp_path / "in"), schema, steps, run)
    left = last[-1].lastProgress.stateOperators[0].numRowsTotal if last[-1].lastProgress else None
    return spark.read.parquet(out).collect(), left


def test_pages_without_a_hole_go_out(spark, tmp_path):
    page = lambda t, n, links=3, more=True, day=0: ("US", t, n, at(day), links, more, f"{t}{n}")
    steps = [[page("a", 3), page("a", 2), page("b", 2), page("end", 1), page("gap", 1), page("gap", 3), page("empty", 1, links=0), page("a", None)],
             [page("a", 1), page("a", 1), page("end", 2, more=False), page("end", 3), page("gap", 4), page("empty", 2), page("zero", 0), page("nul", 1, more=None)],
             [("FR", "later", 1, at(50), 1, True, "")]]
    got, left = collected(spark, tmp_path, FACTS, steps, lambda s: reached_stream(s, silence=86400, delay="2 days"))
    pages = sorted((r.search_term, r.page_num, r._row) for r in got if r.ended is None)
    assert pages == [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("empty", 1, "empty1"), ("end", 1, "end1"), ("end", 2, "end2"),
                     ("gap", 1, "gap1"), ("later", 1, ""), ("nul", 1, "nul1")]
    closed = {r.search_term: (r.page_num, r.ended, r.waiting) for r in got if r.ended is not None}
    assert closed == {"a": (3, "silent", 0), "b": (0, "hole", 1), "end": (2, "last page", 0), "gap": (1, "hole", 2),
                      "empty": (1, "last page", 0), "nul": (1, "last page", 0)}
    assert left is None or left <= 4  # only the late term is left


def test_outcomes_come_once_the_page_is_silent(spark, tmp_path):
    t = lambda p, n, kind, error=None, day=0: (p, n, kind, error, at(day))
    steps = [[t("ok", 2, "success"), t("bad", 2, "success"), t("worn", 3, "retry", "e3"), t("open", 1, "retry"), t("late", 4, "success")],
             [t("ok", 1, "retry", "e1"), t("bad", 1, "final", "f"), t("worn", 1, "retry", "e1"), t("worn", 2, "retry"), t("worn", 5, "retry", "e5"), t(None, 1, "success")],
             [t("later", 1, "success", day=50)]]
    got, _ = collected(spark, tmp_path, TRIES, steps, lambda s: outcome_stream(s, "page", silence=86400, delay="2 days"))
    assert {r.page: tuple(r)[1:] for r in got} == {
        "ok": (2, 2, "success", 2, "e1"), "bad": (2, 1, "failed", None, "f"), "worn": (4, 3, "exhausted", None, "e3"),
        "open": (1, 1, "pending", None, None), "late": (1, 3, "exhausted", None, None), None: (1, 1, "success", 1, None)}


def test_waiting_pages_share_values_of_the_state(spark, tmp_path):
    page = lambda n, text: ("US", "t", n, at(0), 3, n < 1100, text)
    odd = [page(n, f"\u00e9{n}") for n in range(3, 1103, 2)]
    even = [page(n, f"\u00e9{n}") for n in range(2, 1103, 2)]
    again = [page(n, "repeat") for n in range(2, 1103)]
    out, states = str(tmp_path / "out"), []

    def run(stream):
        with keyed_state(spark):
            query = (reached_stream(stream, silence=86400, delay="2 days").writeStream.format("parquet").option("path", out)
                     .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        states.extend(p.stateOperators[0].numRowsTotal for p in query.recentProgress[:1] if p.stateOperators)
        return query

    stream_of(spark, str(tmp_path / "in"), FACTS, [odd, even, again, [page(1, "\u00e91")]], run)
    got = [(r.page_num, r._row) for r in spark.read.parquet(out).where("ended is null").orderBy("page_num").collect()]
    assert got == [(n, f"\u00e9{n}") for n in range(1, 1101)]  # page 1100 has no next one
    assert max(states) < 50  # 1,101 pages waited
