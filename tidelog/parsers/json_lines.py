"""One JSON object per line, read through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import request_method, request_path
from ..functions.text import duration_ms, lenient_float, lenient_int, trim_space
from ..functions.times import epoch_time
from .base import Fields, ParseContext, ParserSpec, empty_map, to_events, with_defaults

# Where each field may be found, first present one wins.
CANDIDATES = {
    "request": ("request", "jsonPayload.request", "message", "msg"),
    "verb": ("httpRequest.requestMethod", "method"),
    "url": ("httpRequest.requestUrl", "url", "path"),
    "status": ("status", "jsonPayload.status", "statusCode", "code", "httpRequest.status"),
    "took": ("request_time", "jsonPayload.request_time", "latency", "duration", "httpRequest.latency"),
    "upstream": ("upstream_response_time", "jsonPayload.upstream_response_time"),
    "time": ("time_local", "jsonPayload.time_local", "timestamp", "time", "ts"),
    "severity": ("severity", "level"),
    "agent": ("http_user_agent", "jsonPayload.http_user_agent", "userAgent", "httpRequest.userAgent"),
    "ip": ("remote_addr", "jsonPayload.remote_addr", "clientIp", "httpRequest.remoteIp"),
    "referer": ("http_referer", "jsonPayload.http_referer", "referer", "httpRequest.referer"),
    "bytes": ("body_bytes_sent", "jsonPayload.body_bytes_sent", "size", "httpRequest.responseSize"),
}


def get_field(variant: Column, keys: tuple[str, ...] | list[str]) -> Column:
    """First candidate that is present, as VARIANT.

    A JSON null counts as present and hides later candidates; a key spelled
    with a dot is tried before the nested path.
    """
    found = []
    for key in keys:
        found.append(F.try_variant_get(variant, f"$['{key}']", "variant"))
        if "." in key:
            nested = "".join(f"['{part}']" for part in key.split("."))
            found.append(F.try_variant_get(variant, f"${nested}", "variant"))
    return F.coalesce(*found)


# Strict JSON, as the reference reads it.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# Objects that candidates reach into.
PARENTS = ("jsonPayload", "httpRequest")


def is_document(line: Column) -> Column:
    """Is the line one JSON document, and nothing else?

    As the only element of a list it makes a list of one, and with a zero
    behind it a list of two; a line that closes the list itself can't do both.
    The session's settings have no say in it, and a key may come twice.
    """

    def length(end: str) -> Column:
        return F.size(F.from_json(F.concat(F.lit("["), line, F.lit(end)), "array<string>", _STRICT))

    return F.coalesce((length("]") == 1) & (length(",0]") == 2), F.lit(False))


def _entries(text: Column) -> Column:
    """Entries of a JSON object; values are text, nested objects JSON text."""
    return F.from_json(text, "map<string,string>", _STRICT)


def _find(keys: tuple[str, ...]) -> Column:
    """Same rule as `get_field`, on entry maps: one pass over the text serves
    all fields, which is several times faster than one VARIANT path each."""
    found = F
    for key in keys:
        found = found.when(F.map_contains_key("top", key), F.try_element_at("top", F.lit(key)))
        if "." in key:
            parent, child = key.split(".")
            found = found.when(F.map_contains_key(parent, child), F.try_element_at(parent, F.lit(child)))
    return found


def _is_text(keys: tuple[str, ...]) -> Column:
    return F.schema_of_variant(get_field(F.try_parse_json(F.col("line")), keys)) == "STRING"


def _truthy(text: Column, keys: tuple[str, ...]) -> Column:
    """Null where the reference would call the value falsy: empty text, zero, false."""
    # Written as branches: the type check is the one costly step here, and
    # both sides of an `&` may be evaluated ahead for every row.
    suspect = F.coalesce(text.rlike(r"^(false|-?0(\.0*)?)$"), F.lit(False))
    return F.when(text == "", None).when(suspect, F.when(_is_text(keys), text)).otherwise(text)


def _fields(ctx: ParseContext) -> Fields:
    def text(name: str) -> Column:
        return F.col(f"f_{name}")

    verb, url = text("verb"), text("url")
    request = F.coalesce(text("request"), F.concat(verb, F.lit(" "), url), F.lit("-"))
    status = F.coalesce(lenient_int(text("status")), F.lit(0))
    level = F.upper(text("severity"))
    raw_time = F.coalesce(text("time"), F.lit(""))
    # Digits may be a number (epoch) or a text that merely looks like one.
    digits = raw_time.rlike(r"^-?[0-9.]+([eE][-+]?\d+)?$")
    epoch = F.when(digits, F.when(~_is_text(CANDIDATES["time"]), epoch_time(raw_time.try_cast("double"))))
    return {
        "time": raw_time,
        "timestamp": F.coalesce(epoch, ctx.time(raw_time)),
        "method": F.coalesce(verb, request_method(request)),
        "path": request_path(request),
        "full_request": request,
        "status": status,
        "latency": F.coalesce(duration_ms(text("took"), ctx.fix_ms), F.lit(0.0)),
        "upstream_latency": lenient_float(F.coalesce(text("upstream"), F.lit("0"))),
        "user_agent": F.coalesce(text("agent"), F.lit("-")),
        "remote_ip": F.coalesce(text("ip"), F.lit("-")),
        "referer": F.coalesce(text("referer"), F.lit("-")),
        "severity": F.when(level == "WARNING", "WARN").otherwise(level),
        "log_type": F.when(url.isNotNull() | verb.isNotNull() | (status > 0), "HTTP").otherwise("APP"),
        "body_bytes": lenient_int(F.coalesce(text("bytes"), F.lit("0")), "bigint"),
        "metadata": F.coalesce(F.col("top"), empty_map()),
    }


def parse_json(lines: DataFrame, ctx: ParseContext = ParseContext(), keep_payload: bool = False) -> DataFrame:
    """JSON lines → events; lines that are not JSON are dropped.

    With `keep_payload` the whole object stays available as a VARIANT column.
    """
    line = F.col("line")
    document = F.try_parse_json(line)
    # Null as a whole document has no fields to read.
    valid = lines.filter(is_document(line) & (trim_space(line) != "null"))
    parents = {parent: _entries(F.try_element_at("top", F.lit(parent))) for parent in PARENTS}
    texts = (
        valid.withColumn("top", _entries(line))
        .withColumns(parents)
        .withColumns({f"t_{name}": _find(keys) for name, keys in CANDIDATES.items()})
        .withColumns({f"f_{name}": _truthy(F.col(f"t_{name}"), keys) for name, keys in CANDIDATES.items()})
    )
    fields = with_defaults(_fields(ctx), line)
    extra = [document.alias("payload")] if keep_payload else []
    return to_events(texts, fields, ctx, None, *extra, message="full_request")


def _looks_json(line: Column) -> Column:
    return trim_space(line).startswith("{")


def _score(line: Column, idx: Column) -> Column:
    share = F.avg(_looks_json(line).cast("int"))
    return F.when(_looks_json(F.min_by(line, idx)), 1.0).otherwise(share)


JSON = ParserSpec(
    id="json",
    matches=is_document,
    fields=lambda line, groups: {},
    score=_score,
    exclusive=True,
    parse_all=parse_json,
)
