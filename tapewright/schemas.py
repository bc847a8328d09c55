"""Column lists of the wire tables and of the tables derived from them.

Every wire table begins with COMMON. Prices are whole numbers with four implied
decimals, times are nanoseconds since 1970 in UTC, sides are the wire's '8'
(buy) and '5' (sell), and seq is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

COMMON = "ts_nanos bigint, feed_source string, symbol string, seq bigint, trading_date date"

WIRE = {
    "trades": "size int, price_raw bigint, trade_id bigint, sale_condition_flags smallint",
    "trade_breaks": "size int, price_raw bigint, broken_trade_id bigint, sale_condition_flags smallint",
    "quotes": "bid_size int, bid_price_raw bigint, ask_size int, ask_price_raw bigint, flags smallint",
    "status_events": "event_kind string, sub_type string, reason string, detail string",
    "auction_info": "auction_type string, paired_shares int, reference_price_raw bigint, indicative_clearing_price_raw bigint, imbalance_shares int, imbalance_side string, extension_number smallint, scheduled_auction_time_seconds bigint, auction_book_clearing_price_raw bigint, collar_reference_price_raw bigint, lower_collar_raw bigint, upper_collar_raw bigint",
    "official_prices": "price_type string, price_raw bigint",
    "securities": "flags smallint, round_lot_size int, adjusted_poc_price_raw bigint, luld_tier smallint",
    "retail_liquidity": "indicator string",
    "orders_add": "side string, order_id bigint, size int, price_raw bigint",
    "orders_modify": "order_id bigint, size int, price_raw bigint, modify_flags smallint",
    "orders_delete": "order_id bigint",
    "orders_executed": "order_id bigint, size int, price_raw bigint, trade_id bigint, sale_condition_flags smallint",
    "clear_books": "",
    "level_updates": "side string, event_flags smallint, size int, price_raw bigint",
}

LIFECYCLE = "trading_date date, symbol string, order_id bigint, side string, add_ts_nanos bigint, add_price_raw bigint, add_size int, delete_ts_nanos bigint, execute_ts_nanos bigint, terminal_state string, lifetime_ns bigint, feed_source string"
PACKETS = "capture_id string, packet_no bigint, payload binary"


def wire_schema(table: str) -> StructType:
    return StructType.fromDDL(", ".join(x for x in (COMMON, WIRE[table]) if x))
