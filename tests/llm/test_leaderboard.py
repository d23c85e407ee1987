"""The change feed of leaderboards against a plain version of its contract."""

import datetime
import math
import random
import zlib
from collections import defaultdict

from docfields.llm import leaderboard, queries

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz"


def plain(lines, vendors, items):
    nation, price = dict(vendors), dict(items)
    batches = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, flag, at in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (at.date() - datetime.date(1970, 1, 1)).days if at else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        value = 0
        if amount is not None:
            value = math.floor(100 * amount + 0.5)
        elif quantity is not None and price.get(item) is not None:
            value = quantity * math.floor(100 * price[item] + 0.5)
        batches[min(10, 1 + math.floor((a - 19723) * 10 / 180))].append((s, a, nation.get(vendor), item if item in price else None, -value if flag == "swapped" else value))
    revenue, board, out, seen = defaultdict(lambda: defaultdict(int)), defaultdict(list), [], -math.inf
    for b in sorted(batches):
        days = defaultdict(list)
        for s, a, n, i, value in batches[b]:
            if s + 3 >= seen and n is not None and i is not None:
                days[a, n].append((i, value))
        for (a, n), sold in sorted(days.items()):
            for i, value in sold:
                revenue[n][i] += value
            new = [i for i, v in sorted(revenue[n].items(), key=lambda x: (-x[1], x[0])) if v > 0][:10]
            old, board[n] = board[n], new
            for i in {*old, *new}:
                x, y = (k.index(i) + 1 if i in k else None for k in (old, new))
                if x != y:
                    out.append((n, a, i, b, "enter" if x is None else "exit" if y is None else "move", x, y, revenue[n][i]))
        seen = max(seen, *(x[0] for x in batches[b]))
    return sorted(map(str, out))


def feed(spark, lines, vendors, items, **more):
    tables = spark.createDataFrame(lines, LINES), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double")
    return sorted(str(tuple(r)) for r in leaderboard.changes(tables[0].repartition(3), *tables[1:], **more).collect())


def test_against_plain(spark):
    """A hot nation and item, ties, repeats, nulls in every column, late lines, negative revenue, unknown vendors and items."""
    rng = random.Random(3)
    vendors = [(v, None if v == 9 else 0 if v < 4 else v % 3) for v in range(10)]
    items = [(i, None if i == 5 else 1.5 * (i % 4)) for i in range(40)]
    start = datetime.datetime(2024, 1, 1)

    def line(k):
        at = start + datetime.timedelta(days=min(149, max(0, rng.gauss(k / 20, 8))), hours=rng.randrange(24))
        amount = rng.choice([None, 1.005, 2.5, 10.0, 10.0, -3.0, float(rng.randrange(50))])
        row = [k // 3, k % 4, rng.choice([1, 1, 1, rng.randrange(43)]), rng.randrange(11), rng.choice([None, 1, 3]), amount, rng.choice([None, "kept", "swapped", "returned"]), at]
        if rng.random() < 0.1:
            row[rng.choice([0, 1, 2, 3, 7])] = None
        return tuple(row)

    lines = [line(k) for k in range(2500)]
    lines += lines[:40]
    want = plain(lines, vendors, items)
    assert feed(spark, lines, vendors, items) == want
    assert {c: any(f"'{c}'" in w for w in want) for c in ("enter", "exit", "move")} == {"enter": True, "exit": True, "move": True}


def test_heap_skips_stale_and_double_entries():
    rng, board, held = random.Random(5), leaderboard.Board({}, 3), defaultdict(int)
    for _ in range(3000):
        item, amount = rng.randrange(8), rng.choice([-5, -1, 0, 1, 1, 5])
        board.add(item, amount)
        held[item] += amount
        if rng.random() < 0.3:
            assert board.best() == [i for i, v in sorted(held.items(), key=lambda x: (-x[1], x[0])) if v > 0][:3]


def test_partial_sums_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(leaderboard, "HELD_ROWS", 2)
    start = datetime.datetime(2024, 2, 1)
    lines = [(k, 1, k % 7, k % 2, 1, 1.0 + k % 5, "kept", start) for k in range(200)]
    vendors, items = [(0, 4), (1, 5)], [(i, 1.0) for i in range(7)]
    assert feed(spark, lines, vendors, items) == plain(lines, vendors, items)


def test_empty_and_uncounted(spark):
    start = datetime.datetime(2024, 2, 1)
    assert feed(spark, [], [], []) == []
    assert feed(spark, [(1, 1, 1, 1, 1, 1.0, None, start)], [], [(1, 1.0)]) == []
    assert feed(spark, [(1, 1, 1, 1, None, None, None, None)], [(1, 3)], [(1, 1.0)]) == []


def test_query_over_whole_table(spark):
    at = "/root/testdata/sf0.001"
    columns = {"sale_lines": [c.split()[0] for c in LINES.split(", ")], "vendors": ["vendor_id", "nation_id"], "items": ["item_id", "price"]}
    rows = {t: [tuple(r) for r in spark.read.parquet(f"{at}/{t}.parquet").select(*c).collect()] for t, c in columns.items()}
    got = queries.op12_leaderboard(spark, at)
    assert got.dtypes == [tuple(c.replace("long", "bigint").split()) for c in leaderboard.CHANGES.split(", ")]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(*rows.values())
