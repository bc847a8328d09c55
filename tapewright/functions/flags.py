"""Flag bits and codes of wire messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of sale conditions, quotes, securities, modifies and level updates.
INTERMARKET_SWEEP, EXTENDED_HOURS, ODD_LOT, TRADE_THROUGH_EXEMPT, SINGLE_PRICE_CROSS = 0x80, 0x40, 0x20, 0x10, 0x08
QUOTE_HALTED, QUOTE_OFF_HOURS = 0x80, 0x40
SECURITY_TEST, SECURITY_ETP, SECURITY_WHEN_ISSUED = 0x80, 0x40, 0x20
MODIFY_KEEPS_PRIORITY, UPDATE_COMPLETE = 0x01, 0x01


def has(flags: Column, bit: int) -> Column:
    return flags.cast("int").bitwiseAND(bit) != 0


def last_sale_eligible(flags: Column) -> Column:
    return ~has(flags, EXTENDED_HOURS) & ~has(flags, ODD_LOT)


def high_low_eligible(flags: Column) -> Column:
    return last_sale_eligible(flags) & ~has(flags, SINGLE_PRICE_CROSS)


def volume_eligible(flags: Column) -> Column:
    """Every trade counts for volume."""
    return flags.isNotNull() | F.lit(True)


def quote_state(flags: Column) -> Column:
    return F.when(has(flags, QUOTE_HALTED), "halted").when(has(flags, QUOTE_OFF_HOURS), "off_hours").otherwise("open")


def side_name(side: Column) -> Column:
    return F.when(side == "8", "buy").when(side == "5", "sell").otherwise("unknown")


def price(price_raw: Column) -> Column:
    return price_raw / F.lit(10_000.0)


def luld_tier(tier: Column) -> Column:
    return F.when(tier == 1, "tier 1").when(tier == 2, "tier 2").otherwise("not applicable")
