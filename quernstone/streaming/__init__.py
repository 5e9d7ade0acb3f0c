from quernstone.streaming.dedup import dedup_stream
from quernstone.streaming.run import run_append, run_to_end, run_update
from quernstone.streaming.totals import running_totals
from quernstone.streaming.upserts import compact, create_table, read_table, upsert_batch, upsert_stream
from quernstone.streaming.windows import stream_sessions, stream_tumbling

__all__ = [
    "compact",
    "create_table",
    "dedup_stream",
    "read_table",
    "run_append",
    "run_to_end",
    "run_update",
    "running_totals",
    "stream_sessions",
    "stream_tumbling",
    "upsert_batch",
    "upsert_stream",
]
