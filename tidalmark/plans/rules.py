"""The constraints of the feeds and of the feature families, and their report."""

from __future__ import annotations

from ..operators.constraints import WARNING, Rule, finite, merged, one_of, present, ranges, report
from ..sources import feeds
from ..sources.feeds import CHAIN_SQL, FLOW_SQL, TRADES_SQL
from . import families, futures, series  # noqa: F401  (their queries are registered before they are named here)
from .registry import ORACLE_SQL, QUERIES, query

# The bounds of the features, by family.  "-": none.
BOUNDS = {
    "fam_price": """
        0 -: mid micro_volatility micro_fair
        -1 -: tick_return bid_return ask_return mid_return slippage
        -1 1: tick_direction imbalance""",
    "fam_book": """
        0 -: depth_bid depth_ask entropy turnover
        -1 1: imbalance depth_skew""",
    "fam_tick": """
        0 -: large_trades avg_size buy_size sell_size small_vol mid_vol big_vol sequence_entropy
        -1 1: imbalance polarity
        0 1: aggressor_ratio""",
    "fam_chain": """
        0 -: oi_calls oi_puts best_bid_iv best_ask_iv moneyness_size vol_of_vol
        0 1: call_ratio""",
    "fam_technical": """
        0 -: bb_width donchian volatility garman_klass
        -10 10: bb_upper_dev
        0 1: range_position
        0 100: stoch_k stoch_d choppiness
        -100 0: williams_r
        -1000 1000: roc
        -500 500: cci""",
    "fam_cross": """
        -1000000 1000000: spread basis_change
        -0.5 0.5: funding_8h
        -10000 10000: basis_velocity
        -1 1: corr_24""",
    "fam_regime_higher": """
        0 1: liquidity spread_stability
        -20 20: z_price
        -5 5: log_return
        -100 100: return_over_spread
        -10 10: imbalance_return
        -1000000 1000000: pca1""",
    "fam_meta": """
        0 -: masked latency_ms seq
        0 1: confidence""",
    "fam_cycle": """
        -3.141593 3.141593: phase frequency
        1 128: period
        -6.283186 6.283186: acceleration
        0 1: consistency""",
    "fut_open_interest": "0 -: oi turnover",
    "fut_positioning": "0 -: ratio long_proxy short_proxy",
    "fut_liquidation": "0 -: liq_long liq_short heat",
    "fut_volume": "0 -: trade_volume large_volume",
}
FINITE = {
    "fam_greeks": "delta_net gamma_net vega_net theta_net vanna_net charm_net gamma_flow delta_flow",
    "fut_funding": "rate rate_change z_f pressure",
    "fut_basis": "basis basis_change z_b",
    "fut_leverage": "leverage_pressure",
    "fut_regime": "derivatives_stress",
}
DOMAINS = {
    "fam_regime_higher": one_of("state", ["trend", "range", "mean_revert"]),
    "fut_funding": one_of("funding_flag", [-1, 0, 1]),
    "fut_regime": one_of("leverage_flag", [-1, 0, 1]),
}
FLAGS = {"fam_price": "jump_flag sweep_flag", "fam_chain": "iv_crush", "fam_meta": "stale", "fut_funding": "funding_extreme", "fut_basis": "basis_flag", "fut_regime": "basis_extreme"}


def family_rules(name: str) -> list[Rule]:
    """Ranges, finite values, domains, and flags without nulls."""
    return [*ranges(BOUNDS.get(name, "")), *finite(FINITE.get(name, "")), *DOMAINS.get(name, []), *present(FLAGS.get(name, ""))]


FAMILIES = sorted({*BOUNDS, *FINITE, *DOMAINS, *FLAGS})

#: Rules of business of the feeds; warnings are about what is odd and not impossible.
FEED_RULES = {
    "trades": [
        *present("symbol ts seq price size"), Rule("price positive", "price > 0"), Rule("size positive", "size > 0"), *one_of("aggressor", [-1, 0, 1]),
        Rule("size usual", "size <= 95", WARNING),
    ],
    "flow": [*present("symbol ts seq event_type"), Rule("price positive", "price > 0"), *one_of("event_type", ["add", "cancel", "trade"]), *ranges("-1 1: inventory_pressure", WARNING)],
    "chain": [
        *present("symbol ts strike tte kind"), Rule("strike positive", "strike > 0"), Rule("bid not over ask", "bid_iv <= ask_iv"), Rule("expiry ahead", "tte > 0"),
        Rule("volatility positive", "iv > 0"), *ranges("0 -: oi volume premium bid_iv ask_iv"), *one_of("kind", ["call", "put"]), Rule("moneyness usual", "strike / spot BETWEEN 0.5 AND 2", WARNING),
    ],
}


def report_sql(source: str, dataset: str, rules: list[Rule]) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE NOT ({r.holds})) AS r{k}" for k, r in enumerate(rules))
    lines = " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{r.name}' AS rule, '{r.severity}' AS severity, n_rows, r{k} AS n_broken FROM one" for k, r in enumerate(rules)
    )
    return f"{source}, one AS (SELECT count(*) AS n_rows, {counts} FROM {dataset}) {lines}"


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({report_sql(f'WITH {sql}', name, FEED_RULES[name])})" for name, sql in (("trades", TRADES_SQL), ("flow", FLOW_SQL), ("chain", CHAIN_SQL))
    )
)
def feed_constraints(spark, sf_dir):
    """Broken rows by rule of the trades, the order flow and the option chain."""
    sources = {"trades": feeds.trades, "flow": feeds.orderflow, "chain": feeds.chain}
    return merged([report(f(spark, sf_dir), name, FEED_RULES[name]) for name, f in sources.items()])


# The larger families come from shared steps; their rules are checked where they are written.
REPORTED = ["fam_price", "fam_book", "fam_tick", "fam_chain", "fam_greeks", "fam_technical", "fam_cross", "fam_regime_higher", "fam_meta", "fut_open_interest", "fut_volume"]


@query(
    " UNION ALL ".join(f"SELECT * FROM ({report_sql(f'WITH {name} AS ({ORACLE_SQL[name]})', name, family_rules(name))})" for name in REPORTED)
)
def family_constraints(spark, sf_dir):
    """Broken rows by rule of the feature families, each from one pass over it."""
    return merged([report(QUERIES[name](spark, sf_dir), name, family_rules(name)) for name in REPORTED])
