"""Rows for the boundary conditions of the retail model."""

from datetime import date, datetime
from decimal import Decimal as D

from larkspur.sources.catalog import Database

AS_OF = datetime(2025, 7, 15, 9, 30)


def t(y, m, d, h=10, mi=0, s=0):
    return datetime(y, m, d, h, mi, s)


def order(i, customer, at, amount, status="Completed", approval=False):
    return (i, customer, at, D(amount), D("0.00"), None, status, approval, None, None, None)


def database(spark):
    at = t(2025, 1, 1)
    return Database.from_rows(
        spark,
        categories=[(1, "Widgets"), (2, "Gadgets"), (3, "Empty")],
        warehouses=[(1, "North"), (2, "South")],
        customers=[
            (1, "u-1", "Ann", "Lee", "ann@example.com", "1", date(1990, 12, 31), None, at, None),
            (2, None, "Bob", "Ray", "@home", None, None, 1, at, None),
            (3, None, "Cy", "Fox", "a@b.c", None, date(2000, 1, 1), 2, at, None),
            (4, None, "Di", "Moe", "nomail", None, date(2000, 1, 1), 3, at, None),
            (5, None, "Ed", "Poe", "ed_x@example.com", None, None, 4, at, None),
            (6, None, "Flo", "Kay", "flo@example.com", None, None, 5, at, None),
            (7, None, "Gus", "Jay", "gus@example.com", None, None, 6, at, None),
            (8, None, "Hal", "Orr", "hal@example.com", None, None, None, at, None),
        ],
        products=[
            (1, "W-1", "Bolt", "Widgets", 1, D("20.0000"), D("1.000"), True, 5, 50, 1, t(2025, 7, 1), None),
            (2, "W-2", "Bolt", "Widgets", 1, D("10.0000"), D("2.500"), True, None, 30, 2, t(2025, 6, 1), None),
            (3, "G-1", "Gear_100%", "Gadgets", 2, D("99.9900"), None, True, 10, 20, None, t(2025, 5, 1), None),
            (4, "G-2", "Lamp", "Gadgets", 2, D("5.0000"), D("0.500"), False, 50, 10, 1, t(2025, 4, 1), None),
            (5, "N-1", "Cord", None, None, D("29.9900"), D("4.350"), True, 3, 10, 1, t(2025, 3, 1), None),
        ],
        inventory=[(1, 1, 5, None, t(2025, 7, 5)), (1, 2, 4, None, None), (2, 1, 10, None, t(2025, 6, 15)), (2, 2, 50, None, None), (3, 1, 40, None, None), (4, 1, 1, None, None), (5, 1, 3, None, None)],
        purchase_orders=[(7, 2, 1, 5, "InTransit", "x", at), (8, 1, 1, 5, "Received", "x", at)],
        coupons=[(1, "TEN", D("10.00"), True, t(2030, 1, 1), 0), (2, "OLD", D("50.00"), True, t(2020, 1, 1), 3), (3, "OFF", D("50.00"), False, t(2030, 1, 1), 0)],
        orders=[
            order(1, 1, t(2025, 6, 1), "100.0000"),
            order(2, 1, t(2025, 6, 30, 0), "1000.0000"),  # midnight of the last day: counts
            order(3, 1, t(2025, 6, 30, 15), "50.0000"),  # later that day: does not
            order(4, 2, t(2025, 6, 8), "999.9900"),  # a Sunday
            order(5, 3, t(2025, 6, 9), "30.0000", "Cancelled"),
            order(6, 3, t(2025, 4, 2), "20.0000", "Refunded"),
            order(7, 5, t(2025, 3, 1), "5000.0000"),
            order(8, 6, t(2025, 5, 31), "1000.0100", "Pending"),
            order(9, 6, t(2025, 5, 31, 11), "1000.0000", "Pending", True),
            order(10, 1, t(2025, 7, 14), "49.9900"),
        ],
        order_lines=[
            (1, 1, 1, 2, D("20.0000"), D("40.0000")), (2, 1, 2, 6, D("10.0000"), None), (3, 2, 1, 3, D("25.0000"), None), (4, 3, 2, 100, D("10.0000"), None), (5, 4, 3, 1, D("99.9900"), None), (6, 5, 1, 9, D("20.0000"), None),
            (7, 6, 1, 1, D("20.0000"), None), (8, 10, 5, 1, D("29.9900"), None), (9, 7, 1, 4, D("20.0000"), None), (10, 7, 1, 7, D("20.0000"), None), (11, 4, 2, 2, D("10.0000"), None),
        ],
        product_staging=[
            (1, None, "W-1", "Bolt", D("21.0000"), 1, True, date(2025, 7, 1), None), (2, None, "W-2", "Bolt", D("10.0000"), 1, True, date(2025, 7, 1), None), (3, None, "G-1", "Other", D("1.0000"), 2, False, date(2025, 7, 1), None),
            (4, None, "Z-1", "New", D("7.0000"), 1, True, date(2025, 7, 1), None), (5, None, "Z-2", "Off", D("7.0000"), 1, False, date(2025, 7, 1), None), (6, None, "Z-3", "Gone", D("7.0000"), 1, True, date(2025, 7, 1), date(2025, 7, 10)),
        ],
        employees=[(1, None, "Boss", "CEO"), (2, 1, "Aide", None)],
    )
