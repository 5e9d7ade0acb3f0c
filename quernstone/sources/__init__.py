from quernstone.sources.legacy_csv import ingest_csv, write_csv
from quernstone.sources.partitioned import write_partitioned
from quernstone.sources.tables import SCHEMAS, load, load_stream

__all__ = ["SCHEMAS", "ingest_csv", "load", "load_stream", "write_csv", "write_partitioned"]
