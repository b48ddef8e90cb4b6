"""Model parameters.  Fixed values: results depend on every one of them."""

from __future__ import annotations

# --- trading rules (fixed values)
PRICE_BAND = {"HOSE": 0.07, "HNX": 0.10, "UPCOM": 0.15}
BAND_TOLERANCE = 0.005
FEE_ROUND_TRIP = 0.0025
SELL_TAX = 0.001
PARTICIPATION = 0.10
LOT = 100

# --- liquidity (fixed values)
MIN_LIQUID_VALUE = 1e9
MIN_OPPORTUNITY_VALUE = 5e9
MIN_SESSIONS = 120
TRADABLE = {
    "min_volume": 100_000.0,
    "min_price": 5_000.0,
    "max_price": 300_000.0,
    "min_bars": 250,
    "stale_days": 14,
}
PRICE_STALE_DAYS = 30

# --- technical score (fixed values)
TECH_WEIGHTS = {"macd": 0.30, "rsi": 0.25, "ichimoku": 0.45}
DIVERGENCE_PENALTY = 25.0
LOW_VOLUME_RATIO = 0.5
ACTIONS = [(60.0, "MUA"), (20.0, "TÍCH LUỸ"), (-20.0, "THEO DÕI"), (-60.0, "GIẢM TỶ TRỌNG")]
ACTION_FLOOR = "BÁN"
STOP_ATR = 1.5
TARGET_ATR = 3.0
ICHIMOKU_PRESETS = {"six_day_week": (9, 26, 52), "five_day_week": (7, 22, 44)}
RSI_UPPER = (65.0, 85.0)
RSI_LOWER = (15.0, 35.0)
SCREENS = {
    "breakout": {"max_break_bars": 3, "max_cross_bars": 3, "min_volume_ratio": 1.5},
    "accumulate": {"max_thickness": 1.0, "max_volume_ratio": 0.8},
    "warning": {"max_break_bars": 3},
}

# --- disclosure (fixed values)
ANNUAL_VISIBLE = (4, 1)
QUARTER_LAG_DAYS = (45, 45, 45, 60)
PUBLICATION_DELAY_DAYS = 1
BASIS_ACTUAL = "ngày công bố thật"
BASIS_RULE = "quy tắc trễ chuẩn"

# --- valuation (fixed values)
RISK_FREE = 0.03
EQUITY_PREMIUM = 0.08
BETA_RANGE = (0.6, 1.8)
DEFAULT_BETA = 1.0
KE_FLOOR = 0.12
TERMINAL_GROWTH = 0.03
GROWTH_RANGE = (-0.10, 0.20)
DEFAULT_GROWTH = 0.05
DEFAULT_KD = 0.08
KD_RANGE = (0.05, 0.12)
TAX = 0.20
DCF_YEARS = 5
BANK_G_CAP = 0.06
METHOD_WEIGHTS = {
    "NON_FINANCIAL": {"pe_relative": 0.35, "pb_relative": 0.15, "ev_ebitda": 0.15, "dcf_fcff": 0.35},
    "BANK": {"justified_pb": 0.50, "pb_relative": 0.30, "pe_relative": 0.20},
    "SECURITIES": {"pb_relative": 0.60, "pe_relative": 0.40},
    "INSURANCE": {"pb_relative": 0.60, "pe_relative": 0.40},
    "REAL_ESTATE": {"pb_relative": 0.60, "pe_relative": 0.40},
}
COMPANY_TYPES = ["BANK", "SECURITIES", "INSURANCE", "REAL_ESTATE", "NON_FINANCIAL"]

# --- composite score and rating (fixed values)
GROUP_WEIGHTS = {
    "macro": 0.10,
    "sector": 0.15,
    "quality": 0.20,
    "growth": 0.10,
    "valuation": 0.25,
    "technical": 0.10,
    "sentiment": 0.10,
}
MIN_GROUPS = 3
RATINGS = ["BÁN", "KÉM KHẢ QUAN", "NẮM GIỮ", "KHẢ QUAN", "MUA"]
RATING_BANDS = [(0.20, 4), (0.10, 3), (-0.05, 2), (-0.15, 1)]
UPGRADE_SCORE = 70.0
DOWNGRADE_SCORE = 40.0
WATCH = "THEO DÕI"
LOW, MEDIUM, HIGH = "THẤP", "TRUNG BÌNH", "CAO"

# --- macro models (fixed values): indicator -> (neutral, width, weight)
DOMESTIC = {
    "gdp_growth": (6.0, 1.5, 1.0),
    "cpi": (3.5, 1.5, -0.6),
    "policy_rate": (4.5, 1.0, -0.6),
    "credit_growth": (13.0, 3.0, 0.6),
    "usd_vnd": (2.0, 2.0, -0.4),
}
DOMESTIC_SENSITIVITY = {
    "BANK": {"gdp_growth": 0.8, "cpi": -0.3, "policy_rate": -0.4, "credit_growth": 1.0, "usd_vnd": -0.3},
    "SECURITIES": {"gdp_growth": 0.6, "cpi": -0.3, "policy_rate": -1.0, "credit_growth": 0.7, "usd_vnd": -0.5},
    "INSURANCE": {"gdp_growth": 0.5, "cpi": -0.2, "policy_rate": 0.4, "credit_growth": 0.2, "usd_vnd": -0.2},
    "REAL_ESTATE": {"gdp_growth": 0.7, "cpi": -0.4, "policy_rate": -1.0, "credit_growth": 0.9, "usd_vnd": -0.3},
    "NON_FINANCIAL": {"gdp_growth": 0.8, "cpi": -0.4, "policy_rate": -0.5, "credit_growth": 0.4, "usd_vnd": -0.2},
}
# series -> (basis, neutral, width, weight)
INTERNATIONAL = {
    "fed_funds": ("level", 3.0, 1.5, -0.6),
    "ust_10y": ("level", 4.0, 1.0, -0.8),
    "usd_broad": ("chg_3m", 0.0, 0.03, -0.7),
    "brent": ("chg_3m", 0.0, 0.15, -0.3),
    "vix": ("level", 18.0, 6.0, -0.8),
}
RATE_SERIES = ["fed_funds", "fed_funds_daily", "ust_10y"]
INTERNATIONAL_SENSITIVITY = {
    "BANK": {"fed_funds": -0.3, "ust_10y": -0.4, "usd_broad": -0.5, "brent": -0.2, "vix": -0.6},
    "SECURITIES": {"fed_funds": -0.5, "ust_10y": -0.6, "usd_broad": -0.6, "brent": -0.2, "vix": -1.0},
    "INSURANCE": {"fed_funds": 0.2, "ust_10y": 0.3, "usd_broad": -0.3, "brent": -0.1, "vix": -0.4},
    "REAL_ESTATE": {"fed_funds": -0.5, "ust_10y": -0.7, "usd_broad": -0.4, "brent": -0.3, "vix": -0.5},
    "NON_FINANCIAL": {"fed_funds": -0.3, "ust_10y": -0.4, "usd_broad": -0.5, "brent": -0.3, "vix": -0.5},
}
# industry overrides of single series sensitivities
INTERNATIONAL_BY_INDUSTRY = {
    "Dầu khí": {"brent": 0.8},
    "Du lịch và Giải trí": {"brent": -0.8},
    "Tiện ích Cộng đồng": {"brent": -0.2},
}
INTERNATIONAL_WEIGHT = 0.30

# --- evaluation (fixed values)
TRADING_DAYS = 252
SECTOR_CAP = 0.35
HORIZONS = {1: 21, 3: 63, 6: 126}
NEWEY_WEST_LAGS = {1: 0, 3: 2, 6: 5}
MIN_CROSS_SECTION = 20
GRID = [(10, "M"), (10, "Q"), (20, "M"), (20, "Q")]
TRAIN_MONTHS, TEST_MONTHS = 24, 6
EULER_GAMMA = 0.5772156649015329

UNCLASSIFIED = "Chưa phân loại"
