"""Declared layouts: source headers to column names, table keys, and list values.

Everything in this file is a fixed value: headers must equal the vendor's, names must equal the tables'.
"""

from __future__ import annotations

# Source header -> column, per table.
PRICE_COLUMNS = {
    "證券代碼": "security_code",
    "年月日": "date",
    "開盤價(元)": "open",
    "最高價(元)": "high",
    "最低價(元)": "low",
    "收盤價(元)": "close",
    "成交量(千股)": "volume_k_shares",
    "成交值(千元)": "turnover_k_twd",
    "報酬率％": "return_pct",
    "報酬率-Ln": "return_ln",
    "週轉率％": "turnover_rate_pct",
    "流通在外股數(千股)": "shares_outstanding_k",
    "市值(百萬元)": "market_cap_m",
    "市值比重％": "market_cap_weight_pct",
    "成交值比重％": "turnover_value_weight_pct",
    "成交筆數(筆)": "trade_count",
    "本益比-TSE": "pe_tse",
    "股價淨值比-TSE": "pb_tse",
    "股價營收比-TEJ": "ps_tej",
    "股利殖利率-TSE": "div_yield_tse",
    "現金股利率": "cash_div_rate",
    "股價漲跌(元)": "price_change",
    "高低價差%": "hl_spread_pct",
    "注意股票(A)": "alert_a",
    "處置股票(D)": "disposition_d",
    "全額交割(Y)": "full_delivery_y",
    "超額報酬(日)-大盤": "excess_return_daily",
    "CAPM_Beta 一年": "capm_beta_1y",
    "漲跌停": "price_limit",
}

CHIP_COLUMNS = {
    "證券代碼": "security_code",
    "年月日": "date",
    "外資買賣超(張)": "fi_net_buy_lot",
    "投信買賣超(張)": "it_net_buy_lot",
    "自營買賣超(張)": "dt_net_buy_lot",
    "合計買賣超(張)": "total_net_buy_lot",
    "外資買賣超日數": "fi_net_days",
    "投信買賣超日數": "it_net_days",
    "自營買賣超日數": "dt_net_days",
    "法人買賣超日數": "inst_net_days",
    "外資總投資股率%": "fi_holding_pct",
    "投信持股率%": "it_holding_pct",
    "合計持股率%": "total_holding_pct",
    "融資餘額(張)": "margin_balance_lot",
    "融資買進(張)": "margin_buy_lot",
    "融資賣出(張)": "margin_sell_lot",
    "融資使用率": "margin_usage_pct",
    "融資維持率": "margin_maint_ratio",
    "融券餘額(張)": "short_balance_lot",
    "融券賣出(張)": "short_sell_lot",
    "融券使用率": "short_usage_pct",
    "券資比": "short_margin_ratio",
    "借券賣出餘額(張)": "sec_lending_balance_lot",
    "借券賣出(張)": "sec_lending_sell_lot",
    "融券買進(張)": "short_buy_lot",
    "融券維持率": "short_maint_ratio",
    "整戶維持率": "overall_maint_ratio",
    "融資限額": "margin_limit_lot",
    "融券限額": "short_limit_lot",
    "融券(買+賣)/成交量 %": "short_vol_ratio_pct",
    "融資(買+賣)/成交量 %": "margin_vol_ratio_pct",
}

# Chip headers that are dropped instead of going to the overflow map.
CHIP_IGNORED = (
    "當日收盤",
    "未調整收盤價(元)",
    "流通在外股數(千股)",
    "外資買賣超(千股)",
    "投信買賣超(千股)",
    "自營買賣超(千股)",
    "合計買賣超(千股)",
)

MARKET_COLUMNS = {
    "證券代碼": "security_code",
    "年月日": "date",
    "成交金額": "trade_amount",
    "成交數量": "trade_volume",
    "成交筆數": "trade_count",
    "總委買數量": "total_bid_volume",
    "總委買筆數": "total_bid_count",
    "總委賣數量": "total_ask_volume",
    "總委賣筆數": "total_ask_count",
    "漲停委買數量": "limit_up_bid_volume",
    "漲停委買筆數": "limit_up_bid_count",
    "漲停委賣數量": "limit_up_ask_volume",
    "漲停委賣筆數": "limit_up_ask_count",
    "跌停委買數量": "limit_down_bid_volume",
    "跌停委買筆數": "limit_down_bid_count",
    "跌停委賣數量": "limit_down_ask_volume",
    "跌停委賣筆數": "limit_down_ask_count",
    "上漲家數": "advance_count",
    "下跌家數": "decline_count",
    "持平家數": "unchanged_count",
    "未成交家數": "no_trade_count",
    "漲停家數": "limit_up_count",
    "跌停家數": "limit_down_count",
}

INTL_INDEX_COLUMNS = {"證券代碼": "security_code", "年月日": "date", "指數": "index_value"}

DIRECTOR_COLUMNS = {
    "證券代碼": "security_code",
    "年月": "month",
    "總股數": "total_shares",
    "董監持股%": "director_holding_pct",
    "大股東持股(TSE)%": "major_shareholder_pct",
}

DEPOSIT_COLUMNS = {"證券代碼": "bank", "年月日": "date", "一年定存": "rate_1y"}

# Headers of the comma files, all of them required.
FX_COLUMNS = {
    "currency": "currency",
    "date": "date",
    "close": "close",
    "open": "open",
    "high": "high",
    "low": "low",
    "change%": "change_pct",
}
INDEX_HISTORY_COLUMNS = {
    "指數代碼": "index_code",
    "指數名稱": "index_name",
    "日期": "trade_date",
    "價格指數值": "price_index",
    "報酬指數值": "return_index",
    "漲跌點數": "change_pts",
    "漲跌百分比": "change_pct",
}
REVENUE_COLUMNS = {
    "代號": "security_code",
    "名稱": "security_name",
    "年度月份": "month",
    "當月營收_仟元": "revenue_ntd_thousand",
}

# Text columns of the price table (all other non-key columns are numbers).
PRICE_TEXT = ("alert_a", "disposition_d", "full_delivery_y", "price_limit")

# Code lists.
INDEX_CODES = ("SC300", "TM100", "TWN50", "Y9999")
MARKET_CODE = "Y9999"
MARKET_NAME_PART = "加權"
CURRENCIES = ("KRW", "EUR", "JPY", "GBP", "AUD", "CAD", "HKD", "CNY", "TWD")

# Key items of the quarterly accounts.
QUARTERLY_KPI = {
    "eps": "每股盈餘",
    "roe": "ROE(A)－稅後",
    "roa": "ROA(A)稅後息前",
    "gross_margin": "營業毛利率",
    "net_margin": "稅後淨利率",
    "debt_ratio": "負債比率",
}

# Former column names.
LEGACY_NAMES = {"trade_date": "date", "year_month": "month"}
LEGACY_QUARTERLY_NAMES = {"year_month": "season"}

# Decimal types of the index history.
INDEX_HISTORY_TYPES = {
    "price_index": "decimal(18,4)",
    "return_index": "decimal(18,4)",
    "change_pts": "decimal(14,4)",
    "change_pct": "decimal(10,4)",
}

# Price table columns -> names used by the research jobs.
PANEL_NAMES = {
    "hl_spread_pct": "amp_pct",
    "return_pct": "return_pct",
    "excess_return_daily": "excess_pct",
    "volume_k_shares": "volume",
    "market_cap_m": "market_cap",
    "pe_tse": "pe",
    "pb_tse": "pb",
    "div_yield_tse": "div_yield",
    "cash_div_rate": "cash_div",
    "capm_beta_1y": "beta",
    "alert_a": "alert_a",
    "disposition_d": "disposition_d",
    "full_delivery_y": "full_delivery_y",
}


def _ddl(columns, day, text=(), extra="") -> str:
    """Schema of a table from its source columns: a text key, the day, text columns, and numbers else."""
    kinds = {day: "date"} | {c: "string" for c in text}
    names = list(columns.values())
    return ", ".join([f"{c} {'string' if i == 0 else kinds.get(c, 'double')}" for i, c in enumerate(names)] + ([extra] if extra else []))


MASTER_TABLE = "security_code string, ticker string, name string, market string"

#: Table -> declared schema, keys, day. Loads bring their rows to it.
TABLES = {
    "stock_price": (_ddl(PRICE_COLUMNS, "date", PRICE_TEXT), ("security_code", "date"), "date"),
    "chip": (_ddl(CHIP_COLUMNS, "date", extra="extras map<string,double>"), ("security_code", "date"), "date"),
    "market_stats": (_ddl(MARKET_COLUMNS, "date"), ("security_code", "date"), "date"),
    "intl_index": (_ddl(INTL_INDEX_COLUMNS, "date"), ("security_code", "date"), "date"),
    "director_monthly": (_ddl(DIRECTOR_COLUMNS, "month"), ("security_code", "month"), "month"),
    "quarterly": ("security_code string, season date, data map<string,double>", ("security_code", "season"), "season"),
    "deposit_rates": (_ddl(DEPOSIT_COLUMNS, "date"), ("bank", "date"), "date"),
    "fx": (_ddl(FX_COLUMNS, "date"), ("currency", "date"), "date"),
    "index_history": (
        "index_code string, index_name string, trade_date date, " + ", ".join(f"{c} {t}" for c, t in INDEX_HISTORY_TYPES.items()) + ", updated_at timestamp",
        ("index_code", "trade_date"), "trade_date",
    ),
    "monthly_revenue": ("security_code string, security_name string, month date, revenue_ntd_thousand bigint, updated_at timestamp", ("security_code", "month"), "month"),
}
