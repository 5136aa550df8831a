"""Declared schemas of the library's tables. NaN becomes NULL on ingest; money is double."""

from __future__ import annotations

BAR = "datetime timestamp, ticker string, open double, high double, low double, close double, volume double"
TABLES = {
    "bars_1min": BAR,
    "bars_daily": BAR,
    "bars_staging": BAR,
    "backfill_ledger": "ticker string, status string, n_bars bigint, first timestamp, last timestamp, error string, fetched_at timestamp",
    "trading_calendar": "asset_class string, date date, market_open timestamp, market_close timestamp",
    "gap_report": "ticker string, date date, asset_class string, expected_minutes bigint, actual_minutes bigint, completeness double, is_whole_day_gap boolean, needs_refetch boolean",
    "coins_list": "src_pos bigint, id string, symbol string, name string",
    "coin_markets": "id string, name string, market_cap double, market_cap_rank double, circulating_supply double, max_supply double, total_supply double",
    "metadata": "ticker string, asset_class string, name string, sector string, industry string, currency string, exchange string, country string, source string, raw string, market_cap double, market_cap_rank double, last_updated timestamp",
    "panel_sentiment": "date timestamp_ntz, bearish_pct double, bullish_pct double",
    "panel_sentiment_most_bearish": "date timestamp_ntz, rank int, ticker string, split string, pct double",
    "panel_sentiment_most_bullish": "date timestamp_ntz, rank int, ticker string, split string, pct double",
    "panel_top_holdings": "date timestamp_ntz, rank int, ticker string, price double, change_pct double, count double",
    "panel_top_trades": "date timestamp_ntz, rank int, ticker string, contract string, qty double, pnl double",
    "panel_biggest_movers": "date timestamp_ntz, rank int, ticker string, price double, change_pct double",
    "panel_mentions": "date timestamp_ntz, ticker string, rank int, price double, change_pct double, count double",
    "panel_leaderboard": "date timestamp_ntz, rank int, username string, count double",
    "panel_leaderboard_streaks": "date timestamp_ntz, rank int, username string, streak_days double",
    "book_push": "ts timestamp, code string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>",
    "l2_snapshots": "timestamp timestamp, ticker string, side string, level int, price double, size double",
    "signals": "ts timestamp, asset string, asset_pos int, signal double",
    "positions": "symbol string, qty double, avg_entry_price double",
    "open_orders": "order_id string, symbol string, side string, qty double, order_type string, limit_price double",
    "decisions": "seq int, kind string, symbol string, side string, qty double, weight double, order_type string, limit_price double, order_id string, fraction double",
    "control": "name string, written_at timestamp",
}
OHLCV = ["open", "high", "low", "close", "volume"]

# The fundamentals of each asset class by how often they go stale.
FUNDAMENTALS = {
    "equities": {
        "daily": ["marketCap", "sharesOutstanding", "floatShares", "shortPercentOfFloat"],
        "weekly": ["beta"],
        "monthly": ["trailingPE", "forwardPE", "enterpriseToEbitda", "revenueGrowth", "earningsGrowth", "returnOnEquity", "grossMargins", "debtToEquity", "freeCashflow"],
    },
    "etfs": {
        "daily": ["totalAssets", "trailingAnnualDividendYield"],
        "weekly": ["beta3Year", "ytdReturn"],
        "monthly": ["threeYearAverageReturn", "fiveYearAverageReturn", "annualReportExpenseRatio"],
    },
    "cryptos": {"daily": ["market_cap", "circulating_supply", "market_cap_rank"], "monthly": ["max_supply", "total_supply"]},
}
# Days until a table of that frequency is stale.
STALE_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}
