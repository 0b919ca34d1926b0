from finpanel.functions.cleaning import (
    clean_number,
    clean_percent,
    code_of,
    currency_code,
    day_to_int,
    flag,
    market_of,
    name_of,
    parse_day,
    parse_iso_day,
    parse_month_end,
    parse_month_start,
    parse_slash_day,
    text_key,
    text_or_null,
)
from finpanel.functions.measures import (
    book_to_market,
    capped_size_log,
    earnings_yield,
    event_strength,
    excess_of,
    first_present,
    json_number,
    missing_if_zero,
    rounded,
    stars,
    trimmed,
)
