"""Streaming jobs (2.11), run over what is there; the SQL is their batch equivalent."""

import uuid

from pyspark.sql import functions as F

from fieldbook.queries.base import query, table
from fieldbook.session import fresh_folder, shared_dir
from fieldbook.streaming import closing, jobs

C = F.col


def checkpoint(s) -> str:
    """A fresh folder for a stream's state, in the shared folder that the session names."""
    return f"{shared_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"


#: The events come as so many files in time order, one for each micro-batch.
SLICES = 6


def in_order(s, d):
    return table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))


def events(s, d):
    path = fresh_folder(s, "slices")
    jobs.replay_slices(in_order(s, d), "ts", path, SLICES)
    return jobs.snapshots(s, path, files_per_trigger=1)


def run(s, stream, mode: str = "append"):
    return jobs.run_available(stream, f"s_{uuid.uuid4().hex}", checkpoint(s), mode)


@query("k01_deduplicated", "select distinct user_id, event_type, cast(ts as date) as day from events")
def k01(s, d):
    e = events(s, d).withColumn("day", C("ts").cast("date"))
    return run(s, jobs.deduplicated(e, ["user_id", "event_type", "day"], "ts", "2 days").select("user_id", "event_type", "day"))


@query("k02_lines_by_day", "with t as (select cast(ts as date) as d, event_type, count(*) as n from events group by 1, 2) select d as day, event_type, n from t where d + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def k02(s, d):
    return run(s, jobs.lines_by_day(events(s, d), "ts", ["event_type"])).select(C("day").cast("date").alias("day"), "event_type", "n")


@query("k02_sliding_board", "with t as (select event_type, unnest([time_bucket(interval 30 minutes, ts) - i * interval 30 minutes for i in range(0, 4)]) as start from events) select start, event_type, count(*) as n from t where start + interval 2 hours <= (select max(ts) - interval 1 hour from events) group by 1, 2")
def k02_sliding(s, d):
    return run(s, jobs.board_by_window(events(s, d), "ts", ["event_type"])).select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


#: The slice of each event, and what its user's line had moved by the slice's end.
MOVES = f"""with b as (select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high from events), t as (select *, least((epoch_us(ts) - low) * {SLICES} // greatest(high - low, 1), {SLICES} - 1) as slice from events, b),
 e as (select distinct user_id, slice from t), m as (select e.user_id, e.slice, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value from e join t on t.user_id = e.user_id and t.slice <= e.slice group by 1, 2)"""


@query("k03_line_moves", f"{MOVES} select user_id, first_value, last_value, last_value - first_value as move from m where abs(last_value - first_value) >= 5")
def k03(s, d):
    return run(s, jobs.line_moves(events(s, d), "user_id", "ts", "value", 5.0, forget="60 days"), "update")


LINES = "select user_id || '|' || cast(ts as date) as key, ts, value, cast(ts as date) + interval 1 day as start from events"


@query("k03_closing_lines", f"with t as ({LINES}), w as (select max(ts) - interval 1 hour as mark from events), d as (select *, value - lag(value) over (partition by key order by ts, value) as move from t) select key, arg_min(value, ts) as open_value, arg_max(value, ts) as close_value, max(ts) as closed_at, count(*) as n, count(*) filter (abs(move) >= 8) as moves, arg_max(move, abs(move)) filter (abs(move) >= 8) as largest_move from d, w group by key, start, mark having start <= mark")
def k03_closing(s, d):
    rows = in_order(s, d).select(F.concat_ws("|", C("user_id").cast("string"), C("ts").cast("date").cast("string")).alias("line"), "ts", "value", F.date_add(C("ts").cast("date"), 1).cast("timestamp").alias("start"))
    path, state = fresh_folder(s, "lines"), checkpoint(s)
    out = None
    for half in (range(SLICES // 2), range(SLICES // 2, SLICES)):  # the second run starts from the first one's checkpoint
        jobs.replay_slices(rows, "ts", path, SLICES, half)
        stream = closing.closing_lines(jobs.snapshots(s, path, files_per_trigger=1), "line", "ts", "value", "start", 8.0)
        out = jobs.run_available(stream, f"s_{uuid.uuid4().hex}", state)
    return out.withColumn("closed_at", C("closed_at").cast("timestamp_ntz"))
