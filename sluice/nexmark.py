"""The auction benchmark's queries in the relational API.

Each builder takes the source tables by name, so it runs on files, DataFrames
and streams alike.  auction, person and bid have the schemas below.
"""

from __future__ import annotations

from .functions import col, count, max
from .plans import Query, Table
from .schema import Schema
from .time import Duration, Interval, Window
from .types import DataTypes as D
from .types import TimeFormats

AUCTION = Schema({
    "auction_id": D.BIGINT, "item_name": D.STRING, "description": D.STRING, "initial_bid": D.BIGINT, "reserve": D.BIGINT,
    "auction_dateTime": TimeFormats.ISO8601, "expires": TimeFormats.ISO8601, "seller": D.BIGINT, "category": D.BIGINT,
})
PERSON = Schema({
    "person_id": D.BIGINT, "name": D.STRING, "email_address": D.STRING, "credit_card": D.STRING, "city": D.STRING,
    "state": D.STRING, "person_dateTime": TimeFormats.ISO8601, "extra": D.STRING,
})
BID = Schema({
    "auction_id": D.BIGINT, "bidder": D.BIGINT, "price": D.BIGINT, "channel": D.STRING, "url": D.STRING,
    "bid_dateTime": TimeFormats.ISO8601, "extra": D.STRING,
})
#: Fixed values of the benchmark.
Q2_AUCTIONS = (1007, 1020, 2001, 2019, 2087)
Q3_STATES = ("OR", "CA", "ID")
CATEGORY = 10
EURO = 0.87


def _any(column: str, values: tuple) -> object:
    out = col(column) == values[0]
    for v in values[1:]:
        out = out | (col(column) == v)
    return out


def q1(bid: Table) -> Query:
    """Prices in another currency."""
    return bid.select("auction_id", (col("price") * EURO).alias("price_eur"), "bidder", "bid_dateTime")


def q2(bid: Table) -> Query:
    """Bids on some auctions."""
    return bid.where(_any("auction_id", Q2_AUCTIONS)).select("auction_id", "price")


def q3(person: Table, auction: Table, theta: bool = False) -> Query:
    """Who sells in some states, by key or by a condition only."""
    month = Interval(Duration.days(-31), Duration.days(31))
    sellers = person.where(_any("state", Q3_STATES))
    offers = auction.where(col("category") == CATEGORY)
    if theta:
        joined = sellers.join(offers, [], month, where=col("seller") == col("person_id"))
    else:
        joined = sellers.join(offers.rename_columns({"seller": "person_id"}), ["person_id"], month)
    return joined.select("name", "city", "state", "auction_id")


def q5(bid: Table) -> Query:
    """Auctions with the most bids of a window."""
    window = Window.createTBWindow(Duration.hours(12))
    counts = bid.group_by("auction_id", window=window).select("auction_id", count().alias("bids"))
    most = counts.group_by(window=window).select(max("bids").alias("bids"))
    return counts.join(most, ["bids"], Interval(Duration.hours(0), Duration.hours(0))).select("auction_id", "bids")


def q8(person: Table, auction: Table) -> Query:
    """New sellers who offer something soon."""
    near = Interval(Duration.minutes(-1), Duration.hours(12))
    return person.join(auction.rename_columns({"seller": "person_id"}), ["person_id"], near).select("person_id", "name", "auction_id", "reserve")


def q9(bid: Table, auction: Table) -> Query:
    """Winning bid of each auction."""
    valid = (col("auction_dateTime") < col("bid_dateTime")) & (col("bid_dateTime") < col("expires"))
    joined = bid.rename_columns({"extra": "bid_extra"}).join(auction, ["auction_id"], Interval(Duration.hours(-24), Duration.hours(1)), where=valid)
    return joined.group_by("auction_id", window=Window.createTBWindow(Duration.days(2))).select("auction_id", max("price").alias("winning_price"))


def q12(bid: Table) -> Query:
    """Bids of each bidder by second of arrival (ingress time)."""
    return bid.group_by("bidder", window=Window.createTBWindow(Duration.seconds(1))).select("bidder", count().alias("processed"))


def q20(bid: Table, auction: Table) -> Query:
    """Bids with their auction, of one category."""
    near = Interval(Duration.minutes(-1), Duration.hours(12))
    offers = auction.where(col("category") == CATEGORY)
    joined = offers.join(bid, ["auction_id"], near)
    return joined.select(*(n for n in joined.schema.names))
