from finpanel.operators.keys import (
    as_of,
    dedupe_first,
    dedupe_latest,
    expected_diff,
    forward_fill,
    latest,
    on_latest_day,
    set_overlap,
    split_rejects,
)
from finpanel.operators.quantiles import quantiles
from finpanel.operators.stats import (
    box_summary,
    compare_groups,
    curve_bands,
    describe,
    histogram,
    mann_whitney,
    tercile_stats,
    unpivot,
)
