from .ids import log_id
from .labels import (
    determine_severity,
    display_status,
    endpoint_key,
    endpoint_label,
    message_preview,
    scalar_metadata,
    scalar_payload,
    search_key,
    status_class,
)
from .paths import clf_path, normalize_path, request_method, request_path, short_path
from .scores import robust_z, saturation
from .text import duration_ms, is_blank, lenient_float, lenient_int, trim_space
from .times import bucket_label, epoch_time, parse_date
from .tokens import (
    group_key,
    log_template,
    merge_tokens,
    prefix_token,
    token_similarity,
    tokenize,
)
