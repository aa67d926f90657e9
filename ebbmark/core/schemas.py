"""Explicit schemas of the tables the jobs read and write."""

OBS = "entity_id string, series_id string, date date, value double"
STORED_OBS = "entity_id string, series_id string, date date, knowable_from date, value double"
RULES = "input_id string, side string, rule string, pct double, window_kind string, window_n int, min_periods int"
INPUTS = "input_id string, cluster string"
CONTRACTS = "code string, alias string, expect_name_contains string, risk_sign int, in_equities_input boolean, in_risk_basket boolean"
#: As the source delivers them: every column a string.
POSITIONS_RAW = (
    "report_date_as_yyyy_mm_dd string, cftc_contract_market_code string, market_and_exchange_names string, "
    "open_interest_all string, noncomm_positions_long_all string, noncomm_positions_short_all string, "
    "traders_noncomm_long_all string, traders_noncomm_short_all string"
)
POSITIONS = (
    "date date, knowable_from date, code string, alias string, net double, net_pct_oi double, open_interest_all double, "
    "noncomm_positions_long_all double, noncomm_positions_short_all double, traders_noncomm double"
)
CATALOGUE = (
    "inputs array<struct<id: string, name: string, kind: string, frequency: string, field: string, field_alternates: array<string>, "
    "series: array<struct<role: string, field: string, price_field: string, weight_field: string, field_alternates: array<string>, candidates: array<string>>>>>, "
    "defaults struct<field: string>"
)
_SERIES = "struct<ok: boolean, code: string, n: bigint, first_date: string, last_date: string, inferred_frequency: string, history_years: double, staleness_days: bigint>"
PROBE_REPORT = f"targets map<string, struct<label: string, queries: map<string, struct<error: string, hits: array<struct<search_hit: struct<code: string, title: string, region: string, frequency: string>, series: {_SERIES}>>>>>>"
