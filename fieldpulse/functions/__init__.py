"""Scalar column expressions (all JVM-side, codegen friendly)."""

from fieldpulse.functions.numeric import (  # noqa: F401
    clamped_backlog, loss_pct, loss_pct_text, py_repr2, round2, safe_gt,
)
from fieldpulse.functions.parsing import (  # noqa: F401
    parse_cpu, parse_mem_mb, parse_net_mb, parse_published_at,
)
from fieldpulse.functions.timefmt import (  # noqa: F401
    add_millis, batch_stamp, e2e_latency_ms, iso_format, latency_default, stamp_second,
)
