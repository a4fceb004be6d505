from tillscope.functions.columns import (  # noqa: F401
    as_date,
    churn_label,
    money,
    money_avg,
    money_sum,
    pct,
    rfm_segment,
    safe_div,
    score_high_is_good,
    score_low_is_good,
    year_month_label,
)
