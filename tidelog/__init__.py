"""Log analytics on Spark: lines in, one `log_events` table, statistics out."""

from . import functions
from .operators.anomalies import detect_anomalies, endpoint_baselines, score
from .operators.detect import detect_format
from .operators.parse import parse_logs
from .operators.query import LogQuery, available_methods, query_logs, search
from .operators.templates import (
    all_templates,
    assign_templates,
    cluster_assignments,
    cluster_logs,
    learn_templates,
)
from .parsers import ParseContext, ParserSpec, parse_with, register_parser
from .plans.bundle import aggregate_stats, view_digest
from .session import get_session
from .sources.lines import append, read_lines, retain_last, with_line_index
from .sources.store import clear_events, export_csv, load_events, save_events
from .sources.zips import read_zip_lines
from .streaming.arrivals import parse_arrivals
from .streaming.jobs import parse_stream, score_stream, stats_on_append, stream_lines, windowed_signals
