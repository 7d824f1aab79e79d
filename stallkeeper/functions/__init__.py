from stallkeeper.functions.money import (  # noqa: F401
    cents,
    div_half_up,
    dollars,
    mean_dollars,
    pct,
    ratio,
    rnd,
    show_money,
)
from stallkeeper.functions.conditional import avg_if, count_if, distinct_if, sum_if  # noqa: F401
from stallkeeper.functions.bands import ladder, recency_band  # noqa: F401
from stallkeeper.functions.text import (  # noqa: F401
    NULL_TOKENS,
    blank_to_col,
    clean_numeric,
    hash_bucket,
    normalize_risk_label,
    null_token_col,
)
