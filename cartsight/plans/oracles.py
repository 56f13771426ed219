"""For every named analysis that SQL can express, the same result as one SQL statement.

The statements run on the raw sample tables in another engine. They share no code with the
operators: each starts from common table expressions that derive the commerce tables (prefix
``t_``), and then takes the most direct way, whatever it would cost at scale.
"""

from __future__ import annotations

_TABLES = {
    "t_orders": (
        [],
        """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'P' THEN 'shipped' ELSE 'delivered' END AS status,
               o_orderdate AS bought,
               CASE WHEN o_orderkey % 617 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS approved,
               CASE WHEN o_orderkey % 59 <> 0 THEN o_orderdate + INTERVAL 2 DAY END AS handed_over,
               CASE WHEN o_orderstatus = 'P' OR o_orderkey % 1201 = 0 THEN NULL
                    WHEN o_orderkey % 997 = 1 THEN o_orderdate + INTERVAL 170 DAY
                    ELSE o_orderdate + INTERVAL 1 MINUTE * ((o_orderkey * 7919) % 34567)
               END AS arrived,
               o_orderdate + INTERVAL 1 DAY * (18 + o_orderkey % 9) AS promised
        FROM orders
        """,
    ),
    "t_arrivals": (
        ["t_orders"],
        """
        SELECT order_id, customer_id, arrived, promised,
               (epoch_us(arrived) - epoch_us(promised)) / 86400000000.0 AS late,
               round((epoch_us(arrived) - epoch_us(promised)) / 86400000000.0, 1)
                   + CAST(0 AS DOUBLE) AS late1
        FROM t_orders
        WHERE arrived IS NOT NULL AND status = 'delivered'
        """,
    ),
    "t_items": (
        [],
        """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
               l_extendedprice AS price, l_quantity AS freight
        FROM lineitem
        """,
    ),
    "t_customers": (
        [],
        """
        SELECT c_custkey AS customer_id, c_custkey % 97 AS zip, n_name AS state
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        """,
    ),
    "t_sellers": (
        [],
        """
        SELECT s_suppkey AS seller_id, (s_suppkey * 3) % 97 AS zip, n_name AS state
        FROM supplier JOIN nation ON n_nationkey = s_nationkey
        """,
    ),
    "t_products": (
        [],
        """
        SELECT p_partkey AS product_id, CASE WHEN p_partkey % 54 <> 0 THEN p_type END AS category
        FROM part
        """,
    ),
    "t_names": (
        [],
        "SELECT DISTINCT p_type AS category, lower(p_type) AS english FROM part "
        "WHERE p_type <> 'PROMO'",
    ),
    "t_points": (
        [],
        """
        SELECT c_custkey % 95 AS zip, c_name AS city, n_name AS state,
               -30 + (((c_custkey % 95) * 31) % 97) / 8 + (c_custkey % 7) / 1024 AS lat,
               -60 + (((c_custkey % 95) * 53) % 97) / 8 + (c_custkey % 11) / 1024 AS lng
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        """,
    ),
    "t_zips": (
        ["t_points"],
        """
        SELECT zip, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng,
               min({'state': state, 'city': city}) AS place
        FROM t_points GROUP BY zip
        """,
    ),
    "t_placed": (
        ["t_items", "t_orders", "t_customers", "t_sellers", "t_zips"],
        """
        SELECT i.*, o.status, o.customer_id,
               b.zip AS buyer_zip, b.state AS buyer_state,
               z1.lat AS lat1, z1.lng AS lng1, z1.place AS place1,
               v.zip AS shop_zip, v.state AS shop_state,
               z2.lat AS lat2, z2.lng AS lng2,
               pow(sin((z2.lat - z1.lat) * 0.0174533 / 2), 2)
                 + cos(z1.lat * 0.0174533) * cos(z2.lat * 0.0174533)
                   * pow(sin((z2.lng - z1.lng) * 0.0174533 / 2), 2) AS hav
        FROM t_items i
        JOIN t_orders o USING (order_id)
        JOIN t_customers b USING (customer_id)
        JOIN t_sellers v USING (seller_id)
        JOIN t_zips z1 ON z1.zip = b.zip
        JOIN t_zips z2 ON z2.zip = v.zip
        """,
    ),
    "t_shipped": (
        ["t_placed", "t_arrivals"],
        """
        SELECT p.order_id, price, freight, buyer_zip, buyer_state, shop_state, lat1, lng1,
               concat(buyer_state, ' -> ', shop_state) AS route,
               round(6371 * 2 * atan2(sqrt(hav), sqrt(1 - hav)), 1) AS km,
               late1, CAST(late > 0 AS INTEGER) AS is_late,
               CASE WHEN late1 > 0 THEN 'Delayed'
                    WHEN late1 >= -5 THEN 'On-Time (0-5 days early)'
                    ELSE 'Early (5+ days early)' END AS kind
        FROM t_placed p JOIN t_arrivals a USING (order_id)
        """,
    ),
    "t_monthly": (
        ["t_items", "t_orders", "t_customers", "t_products"],
        """
        SELECT category, state, CAST(date_trunc('month', bought) AS DATE) AS ds,
               CAST(sum(CAST(price AS DECIMAL(28, 10))) AS DOUBLE) AS y
        FROM t_items JOIN t_orders USING (order_id) JOIN t_customers USING (customer_id)
             JOIN t_products USING (product_id)
        WHERE status = 'delivered'
        GROUP BY ALL
        """,
    ),
    "t_every_month": (
        ["t_monthly"],
        """
        SELECT s.category, s.state, s.ds, coalesce(m.y, 0) AS y
        FROM (SELECT category, state,
                     CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds
              FROM t_monthly GROUP BY category, state) s
        LEFT JOIN t_monthly m
          ON m.ds = s.ds AND m.category IS NOT DISTINCT FROM s.category
             AND m.state IS NOT DISTINCT FROM s.state
        """,
    ),
    "t_total": (
        ["t_items", "t_orders"],
        """
        SELECT 1 AS category, 1 AS state, CAST(date_trunc('month', bought) AS DATE) AS ds,
               CAST(sum(CAST(price AS DECIMAL(28, 10))) AS DOUBLE) AS y
        FROM t_items JOIN t_orders USING (order_id)
        WHERE status = 'delivered'
        GROUP BY ALL
        """,
    ),
}


def _trend(source: str) -> dict[str, tuple[list[str], str]]:
    """Line per series of ``source``, the months it is drawn over, and its values there."""
    return {
        "t_timed": (
            [source],
            f"""
            SELECT *, date_diff('month', min(ds) OVER (PARTITION BY category, state), ds) AS t
            FROM {source}
            """,
        ),
        "t_lines": (
            ["t_timed"],
            """
            SELECT category, state, count(*) AS n, min(ds) AS d0, max(ds) AS d1,
                   CASE WHEN count(*) > 1 THEN regr_slope(y, t) END AS slope,
                   CASE WHEN count(*) > 1 THEN regr_intercept(y, t) END AS intercept,
                   CASE WHEN count(*) > 2 THEN
                       sqrt(greatest(0, regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t))
                            / (count(*) - 2)) END AS sigma,
                   avg(t) AS t_mean, regr_sxx(y, t) AS sxx
            FROM t_timed GROUP BY category, state
            """,
        ),
        "t_axis": (
            ["t_timed", "t_lines"],
            """
            SELECT category, state, ds FROM t_timed
            UNION ALL
            SELECT category, state, CAST(d1 + INTERVAL 1 MONTH * ahead AS DATE)
            FROM t_lines, range(1, 7) AS r(ahead)
            """,
        ),
        "t_drawn": (
            ["t_axis", "t_lines"],
            """
            SELECT category, state, ds, mid AS yhat, mid - reach AS lo, mid + reach AS hi
            FROM (
                SELECT a.category, a.state, a.ds,
                       intercept + slope * date_diff('month', d0, a.ds) AS mid,
                       1.2815515655446004 * sigma
                         * sqrt(1 + 1.0 / n + pow(date_diff('month', d0, a.ds) - t_mean, 2) / sxx)
                         AS reach
                FROM t_axis a JOIN t_lines l
                  ON a.category IS NOT DISTINCT FROM l.category
                     AND a.state IS NOT DISTINCT FROM l.state
            )
            """,
        ),
    }


def _waves(source: str) -> dict[str, tuple[list[str], str]]:
    """Line and two yearly waves, fitted by making the six features orthogonal one by one.

    ``w_k`` adds o<k>, feature k without the part that features 0 to k-1 explain. On orthogonal
    features every coefficient is a ratio of two sums over the months with sales.
    """
    per = "OVER (PARTITION BY category, state)"
    angle = "(month(ds) - 1) * pi() / 6"
    tables = {
        "t_timed": _trend(source)["t_timed"],
        "t_lines": (
            ["t_timed"],
            """
            SELECT category, state, count(*) AS n, min(ds) AS d0, max(ds) AS d1
            FROM t_timed GROUP BY category, state
            """,
        ),
        "w_axis": (
            ["t_timed", "t_lines"],
            f"""
            SELECT *, 1.0 AS f0, CAST(t AS DOUBLE) AS f1, sin({angle}) AS f2, cos({angle}) AS f3,
                   sin(2 * {angle}) AS f4, cos(2 * {angle}) AS f5
            FROM (
                SELECT category, state, ds, y, t, 1 AS known FROM t_timed
                UNION ALL
                SELECT category, state, CAST(d1 + INTERVAL 1 MONTH * ahead AS DATE), 0,
                       date_diff('month', d0, d1) + ahead, 0
                FROM t_lines, range(1, 7) AS r(ahead)
            )
            """,
        ),
    }
    before = "w_axis"
    for k in range(6):
        shares = [
            f"sum(known * f{k} * o{j}) {per} / sum(known * o{j} * o{j}) {per} AS p{k}{j}"
            for j in range(k)
        ]
        inner = f"SELECT {', '.join(['*', *shares])} FROM {before}"
        own = " - ".join([f"f{k}", *[f"p{k}{j} * o{j}" for j in range(k)]])
        tables[f"w_{k}"] = ([before], f"SELECT *, {own} AS o{k} FROM ({inner})")
        before = f"w_{k}"
    gains = ", ".join(
        f"sum(known * y * o{k}) {per} / sum(known * o{k} * o{k}) {per} AS g{k}, "
        f"o{k} * o{k} / sum(known * o{k} * o{k}) {per} AS h{k}"
        for k in range(6)
    )
    tables["w_gains"] = (["w_5"], f"SELECT *, {gains} FROM w_5")
    tables["w_drawn"] = (
        ["w_gains"],
        f"""
        SELECT *, sqrt(sum(known * pow(y - yhat, 2)) {per} / (sum(known) {per} - 6)) AS sigma
        FROM (
            SELECT *, {' + '.join(f'g{k} * o{k}' for k in range(6))} AS yhat,
                   {' + '.join(f'h{k}' for k in range(6))} AS leverage
            FROM w_gains
        )
        """,
    )
    own = {5: "g5"}
    for j in range(4, -1, -1):
        own[j] = f"(g{j} - " + " - ".join(f"p{k}{j} * {own[k]}" for k in range(j + 1, 6)) + ")"
    names = ["intercept", "slope", "sin_1", "cos_1", "sin_2", "cos_2"]
    coef = ", ".join(f"any_value({own[k]}) AS {name}" for k, name in enumerate(names))
    tables["w_models"] = (
        ["w_drawn"],
        f"""
        SELECT category, state, sum(known) AS n, {coef}, any_value(sigma) AS sigma
        FROM w_drawn GROUP BY category, state
        """,
    )
    return tables


def _changes(source: str, changes: int, reach: float, strengths: range) -> dict[str, tuple[list[str], str]]:
    """Trend with hinges under a ridge penalty, for every strength at once.

    A penalty is one more observation for each hinge, of which all other features are 0. With these
    rows it is plain least squares, solved as in :func:`_waves`. ``actual`` tells observations from
    penalties, and ``known`` both from months to come.
    """
    per = "OVER (PARTITION BY category, state, strength)"
    size = changes + 2
    hinge = {j + 2: f"greatest(x - {reach * (j + 1) / changes!r}, 0)" for j in range(changes)}
    grid = ", ".join(f"(1e{k})" for k in strengths)
    penalties = " UNION ALL ".join(
        "SELECT category, state, strength, NULL AS ds, 0.0 AS y, 0 AS actual, 1 AS known, "
        + ", ".join(f"sqrt(n * strength) AS f{k}" if k == j else f"0.0 AS f{k}" for k in range(size))
        + " FROM c_series, c_grid"
        for j in range(2, size)
    )
    features = "1.0 AS f0, x AS f1, " + ", ".join(f"{hinge[k]} AS f{k}" for k in range(2, size))
    tables = {
        "t_timed": _trend(source)["t_timed"],
        "c_grid": ([], f"SELECT CAST(strength AS DOUBLE) AS strength FROM (VALUES {grid}) v(strength)"),
        "c_series": (
            ["t_timed"],
            """
            SELECT category, state, count(*) AS n, min(ds) AS d0, max(ds) AS d1, avg(y) AS mean,
                   greatest(date_diff('month', min(ds), max(ds)), 1) AS span
            FROM t_timed GROUP BY category, state HAVING count(*) > 2
            """,
        ),
        "c_axis": (
            ["t_timed", "c_series", "c_grid"],
            f"""
            SELECT category, state, strength, ds, y, actual, actual AS known, {features}
            FROM (
                SELECT s.category, s.state, strength, CAST(s.d0 + INTERVAL 1 MONTH * ahead AS DATE) AS ds,
                       coalesce(t.y - s.mean, 0) AS y, CAST(t.y IS NOT NULL AS INTEGER) AS actual,
                       ahead / CAST(s.span AS DOUBLE) AS x
                FROM (SELECT *, unnest(range(0, date_diff('month', d0, d1) + 7)) AS ahead FROM c_series) s
                CROSS JOIN c_grid
                LEFT JOIN t_timed t ON t.t = s.ahead AND t.category IS NOT DISTINCT FROM s.category
                                       AND t.state IS NOT DISTINCT FROM s.state
            )
            UNION ALL {penalties}
            """,
        ),
    }
    before = "c_axis"
    for k in range(size):
        shares = [f"sum(known * f{k} * o{j}) {per} / sum(known * o{j} * o{j}) {per} AS p{k}{j}" for j in range(k)]
        inner = f"SELECT {', '.join(['*', *shares])} FROM {before}"
        own = " - ".join([f"f{k}", *[f"p{k}{j} * o{j}" for j in range(k)]])
        tables[f"c_{k}"] = ([before], f"SELECT *, {own} AS o{k} FROM ({inner})")
        before = f"c_{k}"
    gains = ", ".join(
        f"sum(known * y * o{k}) {per} / sum(known * o{k} * o{k}) {per} AS g{k}, "
        f"o{k} * o{k} / sum(known * o{k} * o{k}) {per} AS h{k}"
        for k in range(size)
    )
    tables["c_gains"] = ([before], f"SELECT *, {gains} FROM {before}")
    tables["c_drawn"] = (
        ["c_gains"],
        f"""
        SELECT category, state, strength, ds, y, actual, {" + ".join(f"g{k} * o{k}" for k in range(size))} AS yhat,
               {" + ".join(f"h{k}" for k in range(size))} AS leverage
        FROM c_gains
        """,
    )
    tables["c_models"] = (
        ["c_drawn"],
        """
        SELECT category, state, strength, n, freedom, sqrt(rss / freedom) AS sigma
        FROM (SELECT category, state, strength, sum(actual) AS n, sum(actual * pow(y - yhat, 2)) AS rss,
                     sum(actual) - sum(actual * leverage) AS freedom
              FROM c_drawn GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY category, state ORDER BY n * rss / pow(freedom, 2), strength DESC) = 1
        """,
    )
    tables["c_forecast"] = (
        ["c_drawn", "c_models", "c_series"],
        """
        SELECT d.category, d.state, d.ds, s.mean + yhat AS yhat,
               1.2815515655446004 * sigma * sqrt(1 + leverage) AS reach
        FROM c_drawn d JOIN c_models m
          ON d.category IS NOT DISTINCT FROM m.category AND d.state IS NOT DISTINCT FROM m.state
             AND d.strength = m.strength
        JOIN c_series s
          ON d.category IS NOT DISTINCT FROM s.category AND d.state IS NOT DISTINCT FROM s.state
        WHERE ds IS NOT NULL
        """,
    )
    return tables


def _statement(body: str, tables: dict) -> str:
    """Put the tables that ``body`` needs, directly or not, in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for before in tables[name][0]:
            add(before)
        if name not in needed:
            needed.append(name)

    for name in tables:
        if name in body:
            add(name)
    parts = ",\n".join(f"{name} AS ({tables[name][1].strip()})" for name in needed)
    return f"WITH {parts}\n{body.strip()}" if parts else body.strip()


def _orphans(child: str, parent: str, key: str) -> str:
    return f"""
        SELECT count(*) AS orphans FROM {child} WHERE {key} NOT IN (SELECT {key} FROM {parent})
    """


def _orphans_in_gaps() -> str:
    items = "SELECT nullif(order_id, CASE WHEN order_id % 11 = 0 THEN order_id END) AS k FROM t_items"
    orders = "SELECT order_id AS k FROM t_orders WHERE order_id % 5 <> 0"
    unknown = f"SELECT CASE WHEN k % 7 <> 0 THEN k END AS k FROM ({orders})"
    cases = [
        ("missing parents", f"k NOT IN ({orders})"),
        ("a NULL among the parents", f"k NOT IN ({unknown})"),
        ("no parents", f"k NOT IN (SELECT k FROM ({orders}) WHERE k < 0)"),
        ("NULL counts as missing", f"k IS NULL OR k NOT IN ({orders})"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS situation, count(*) AS orphans FROM ({items}) WHERE {rule}"
        for name, rule in cases
    )


_BODIES = {
    "o02g_orphans_in_gaps": _orphans_in_gaps(),
    "o02j_orphans_in_gaps_by_join": _orphans_in_gaps(),
    "g06d_dropped_items": """
        SELECT items, placed AS placed_items, items - placed AS dropped_items
        FROM (SELECT (SELECT count(*) FROM t_items) AS items,
                     (SELECT count(*) FROM t_placed) AS placed)
    """,
    "o01_duplicate_orders": """
        SELECT order_id, count(*) AS occurrences FROM t_orders GROUP BY order_id
        HAVING occurrences > 1
    """,
    "o01b_orders_above_ten_items": """
        SELECT order_id, count(*) AS occurrences FROM t_items GROUP BY order_id
        HAVING occurrences > 10
    """,
    "o02_orphan_items": _orphans("t_items", "t_orders", "order_id"),
    "o02b_orders_without_items": _orphans("t_orders", "t_items", "order_id"),
    "o03a_orders_without_customer": _orphans("t_orders", "t_customers", "customer_id"),
    "o03b_customers_without_orders": _orphans("t_customers", "t_orders", "customer_id"),
    "o04a_items_without_product": _orphans("t_items", "t_products", "product_id"),
    "o04b_products_never_sold": _orphans("t_products", "t_items", "product_id"),
    "o05_customer_totals": """
        SELECT count(*) AS "TotalCustomers",
               (SELECT count(DISTINCT customer_id) FROM t_orders) AS "DistinctCustomersInOrders"
        FROM t_customers
    """,
    "o06_null_profile": """
        SELECT count(*) AS total_orders,
               count(*) - count(bought) AS null_purchase,
               count(*) - count(approved) AS null_approved,
               count(*) - count(handed_over) AS null_carrier,
               count(*) - count(arrived) AS null_customer,
               count(*) - count(promised) AS null_estimated
        FROM t_orders
    """,
    "o07_missing_delivery_by_status": """
        SELECT status AS order_status, count(*) AS total_orders,
               count(*) FILTER (arrived IS NULL) AS missing_delivery_date
        FROM t_orders GROUP BY ALL ORDER BY total_orders DESC
    """,
    "o08_delivered_without_date": """
        SELECT order_id, status AS order_status, bought AS order_purchase_timestamp,
               arrived AS order_delivered_customer_date
        FROM t_orders WHERE arrived IS NULL AND status = 'delivered'
    """,
    "o09_worst_delays": """
        SELECT order_id, arrived AS order_delivered_customer_date,
               promised AS order_estimated_delivery_date, late1 AS "DeliveryDelayDays"
        FROM t_arrivals ORDER BY late1 DESC, order_id LIMIT 10
    """,
    "o10_busiest_delivery_days": """
        SELECT CAST(arrived AS DATE) AS "DeliveryDate", count(*) AS "NumberOfOrders"
        FROM t_arrivals GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5
    """,
    "o11_severe_delays_on_day": """
        SELECT count(*) AS severe_delays FROM t_arrivals
        WHERE late > 100 AND CAST(arrived AS DATE) = DATE '1995-06-29'
    """,
    "o12_delay_stats": """
        SELECT round(avg(late), 2) AS "AvgDelayDays", min(late1) AS "BestCase_EarlyDays",
               max(late1) AS "WorstCase_DelayDays"
        FROM t_arrivals
    """,
    "o13_median_delay": """
        SELECT list_sort(list(late1))[1 + count(*) // 2] AS "MedianDelayDays" FROM t_arrivals
    """,
    "o14_payment_types": """
        SELECT event_type AS payment_type, count(*) AS total_transactions,
               round(avg(value), 2) AS avg_payment_value,
               CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) AS total_payment_value
        FROM events GROUP BY ALL ORDER BY total_transactions DESC
    """,
    "d05_payment_share": """
        SELECT event_type AS payment_type, count(*) AS total_transactions,
               round(count(*) / sum(count(*)) OVER (), 4) AS share
        FROM events GROUP BY ALL
    """,
    "o15_top_categories": """
        SELECT english AS product_category_name_english, count(order_id) AS "NumberOfItemsSold",
               CAST(sum(CAST(price AS DECIMAL(28, 10))) AS DOUBLE) AS "TotalRevenue"
        FROM t_items NATURAL JOIN t_products NATURAL JOIN t_names
        GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 10
    """,
    "o16_category_avg_price": """
        SELECT english AS product_category_name_english, round(avg(price), 2) AS "AvgPricePerItem"
        FROM t_items NATURAL JOIN t_products NATURAL JOIN t_names
        WHERE english = 'large' OR english = 'economy' GROUP BY ALL
    """,
    "d07_price_gap": """
        SELECT round(avg(price) FILTER (english = 'large')
                     / avg(price) FILTER (english = 'economy'), 4) AS price_gap
        FROM t_items NATURAL JOIN t_products NATURAL JOIN t_names
    """,
    "o17_above_category_average": """
        SELECT order_id, category AS product_category_name, price
        FROM t_items NATURAL JOIN t_products
        QUALIFY category IS NOT NULL AND price > avg(price) OVER (PARTITION BY category)
    """,
    "d06_above_average_share": """
        SELECT round(count(*) FILTER (category IS NOT NULL AND price > mean)
                     / (SELECT count(*) FROM t_items), 4) AS above_share
        FROM (SELECT category, price, avg(price) OVER (PARTITION BY category) AS mean
              FROM t_items NATURAL JOIN t_products)
    """,
    "o18_null_categories": """
        SELECT count(*) - count(category) AS null_categories FROM t_products
    """,
    "d08_null_category_share": """
        SELECT CAST(round(CAST((count(*) - count(category)) / count(*) AS DECIMAL(18, 9)), 4)
                    AS DOUBLE) AS null_category_share
        FROM t_products
    """,
    "o19_top3_per_category": """
        SELECT category, product_id, price,
               rank() OVER (PARTITION BY category ORDER BY price DESC) AS "RankInCategory"
        FROM t_items NATURAL JOIN t_products
        QUALIFY category IS NOT NULL AND "RankInCategory" <= 3
    """,
    "g01_geo_rows": 'SELECT count(*) AS "Total_Geolocation_Rows" FROM t_points',
    "g02_zip_repetition": """
        SELECT zip AS geolocation_zip_code_prefix, count(*) AS "RepeatCount"
        FROM t_points GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5
    """,
    "g03_geo_summary": """
        SELECT zip AS geolocation_zip_code_prefix, lat AS avg_lat, lng AS avg_lng,
               place.city AS geolocation_city, place.state AS geolocation_state
        FROM t_zips
    """,
    "g05_order_coordinates": """
        SELECT order_id, buyer_zip AS customer_zip_code_prefix, lat1 AS customer_lat,
               lng1 AS customer_lng, shop_zip AS seller_zip_code_prefix, lat2 AS seller_lat,
               lng2 AS seller_lng
        FROM t_placed
    """,
    "g06_order_distance": """
        SELECT order_id, lat1 AS customer_lat, lng1 AS customer_lng, lat2 AS seller_lat,
               lng2 AS seller_lng,
               round(6371 * 2 * atan2(sqrt(hav), sqrt(1 - hav)), 1) AS "DistanceKM"
        FROM t_placed
    """,
    "g07_distance_delay_v1": """
        SELECT order_id, km AS "DistanceKM", late1 AS "DeliveryDelayDays" FROM t_shipped
    """,
    "g08_delay_by_distance_band": """
        SELECT CASE WHEN km < 100 THEN '1. Near (<100km)'
                    WHEN km <= 500 THEN '2. Medium (100-500km)'
                    ELSE '3. Far (>500km)' END AS "DistanceGroup",
               count(*) AS "NumberOfOrders", round(avg(late1), 1) AS "AvgDelayDays"
        FROM t_shipped GROUP BY ALL ORDER BY 1
    """,
    "g09_distance_delay_v2": """
        SELECT order_id, price, freight AS freight_value, buyer_state AS customer_state,
               shop_state AS seller_state, route AS "ShippingRoute", km AS "DistanceKM",
               late1 AS "DeliveryDelayDays", is_late AS "IsDelayed"
        FROM t_shipped
    """,
    "g09v_delayed_pct": """
        SELECT round(100 * avg(is_late), 1) AS "DelayedPct", round(avg(freight), 2) AS "AvgFreight"
        FROM t_shipped
    """,
    "g10_distance_delay_v3": """
        SELECT order_id, price, freight AS freight_value, buyer_state AS customer_state,
               shop_state AS seller_state, route AS "ShippingRoute", km AS "DistanceKM",
               late1 AS "DeliveryDelayDays", is_late AS "IsDelayed",
               buyer_zip AS customer_zip_code_prefix
        FROM t_shipped
    """,
    "g11_delay_category": """
        SELECT order_id, price, freight AS freight_value, buyer_state AS customer_state,
               shop_state AS seller_state, route AS "ShippingRoute", km AS "DistanceKM",
               late1 AS "DeliveryDelayDays", is_late AS "IsDelayed",
               buyer_zip AS customer_zip_code_prefix, kind AS "DelayCategory"
        FROM t_shipped
    """,
    "g12_kpi_pct": """
        SELECT round(100 * avg(is_late), 2) AS "DelayedRatePct",
               round(avg(km), 1) AS "AvgDistanceKM", round(avg(freight), 2) AS "AvgFreightValue"
        FROM t_shipped
    """,
    "g13_kpi_fraction": """
        SELECT round(avg(is_late), 4) AS "DelayedRatePct", round(avg(km), 1) AS "AvgDistanceKM",
               round(avg(freight), 2) AS "AvgFreightValue"
        FROM t_shipped
    """,
    "d01_top_routes": """
        SELECT route AS "ShippingRoute", count(*) AS "NumberOfOrders"
        FROM t_shipped GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10
    """,
    "d02_freight_vs_distance": """
        SELECT freight AS freight_value, km AS "DistanceKM", kind AS "DelayCategory" FROM t_shipped
    """,
    "d03_map_points": """
        SELECT buyer_zip AS customer_zip_code_prefix, lat1 AS customer_lat, lng1 AS customer_lng,
               kind AS "DelayCategory", count(*) AS "NumberOfOrders"
        FROM t_shipped GROUP BY ALL
    """,
    "d04_on_time_rate": "SELECT round(1 - avg(is_late), 4) AS on_time_rate FROM t_shipped",
    "f01_monthly_series": """
        SELECT category AS product_category_name, state AS customer_state, ds, y FROM t_monthly
    """,
    "f01t_monthly_total": "SELECT ds, y FROM t_total",
}
_BODIES["g04_geo_summary_table"] = _BODIES["g03_geo_summary"]
_BODIES["f01c_monthly_from_csv"] = _BODIES["f01t_monthly_total"]

_MODEL = "n, round(slope, 2) AS slope, round(intercept, 2) AS intercept, round(sigma, 2) AS sigma"
_BOUNDS = "round(yhat, 2) AS yhat, round(lo, 2) AS yhat_lower, round(hi, 2) AS yhat_upper"
_ERRORS = """round(avg(abs(y - yhat)), 2) AS mae,
             round(100 * avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)), 2) AS mape"""
_FIT = """FROM t_timed a JOIN t_drawn p
            ON a.ds = p.ds AND a.category IS NOT DISTINCT FROM p.category
               AND a.state IS NOT DISTINCT FROM p.state"""
_LATEST = "QUALIFY row_number() OVER (PARTITION BY category, state ORDER BY ds DESC) <= 10"
_NAMED = "category AS product_category_name, state AS customer_state"

_SERIES_BODIES = {
    "f02_trend_model": f"SELECT {_NAMED}, {_MODEL} FROM t_lines",
    "f04_forecast": f"SELECT {_NAMED}, ds, {_BOUNDS} FROM t_drawn",
    "f05_last10": f"SELECT {_NAMED}, ds, {_BOUNDS} FROM t_drawn {_LATEST}",
    "f06_accuracy": f"""
        SELECT a.category AS product_category_name, a.state AS customer_state, {_ERRORS}
        {_FIT} GROUP BY ALL
    """,
    "f07_export": f"SELECT {_NAMED}, strftime(ds, '%Y-%m') AS ds, {_BOUNDS} FROM t_drawn",
}
_TOTAL_BODIES = {
    "f02t_trend_model_total": f"SELECT {_MODEL} FROM t_lines",
    "f04t_forecast_total": f"SELECT ds, {_BOUNDS} FROM t_drawn",
    "f05t_last10_total": f"SELECT ds, {_BOUNDS} FROM t_drawn {_LATEST}",
    "f06t_accuracy_total": f"SELECT {_ERRORS} {_FIT}",
}

_FILLED_BODIES = {"f02z_trend_zero_filled": _SERIES_BODIES["f02_trend_model"]}
_WAVE_BODIES = {
    "f03_seasonal_model": f"""
        SELECT {_NAMED}, CAST(n AS BIGINT) AS n, round(intercept, 2) AS intercept,
               round(slope, 2) AS slope, round(sin_1, 2) AS sin_1, round(cos_1, 2) AS cos_1,
               round(sin_2, 2) AS sin_2, round(cos_2, 2) AS cos_2, round(sigma, 2) AS sigma
        FROM w_models
    """,
    "f04y_seasonal_forecast": f"""
        SELECT {_NAMED}, ds, {_BOUNDS}
        FROM (SELECT category, state, ds, yhat, yhat - reach AS lo, yhat + reach AS hi
              FROM (SELECT *, 1.2815515655446004 * sigma * sqrt(1 + leverage) AS reach
                    FROM w_drawn))
    """,
}

_TRIED = """FROM (SELECT category, state, ds AS origin, t,
                   regr_slope(y, t) OVER w AS slope, regr_intercept(y, t) OVER w AS intercept,
                   count(*) OVER w AS points
            FROM t_timed WINDOW w AS (PARTITION BY category, state ORDER BY ds)) o
      JOIN (SELECT category, state, t + 0 AS later, y FROM t_timed) a
        ON a.category IS NOT DISTINCT FROM o.category AND a.state IS NOT DISTINCT FROM o.state
           AND later BETWEEN t + 1 AND t + 6
      CROSS JOIN LATERAL (SELECT intercept + slope * later AS yhat)
      WHERE points >= 12"""
_AHEAD = f"CAST(later - t AS INTEGER) AS horizon, count(*) AS n, {_ERRORS} {_TRIED} GROUP BY ALL"
_SERIES_BODIES["f08_rolling_origin"] = f"""
    SELECT o.category AS product_category_name, o.state AS customer_state, {_AHEAD}
"""
_TOTAL_BODIES["f08t_rolling_origin_total"] = f"SELECT {_AHEAD}"
_SERIES_BODIES["f04b_simulated_forecast"] = """
    SELECT * FROM (WITH residuals AS (
        SELECT l.*, row_number() OVER (PARTITION BY l.category, l.state ORDER BY ds) - 1 AS i, t,
               (y - intercept - slope * t) * sqrt(n / nullif(n - 2, 0)) AS r,
               concat_ws('|', '1', coalesce(l.category, ''), coalesce(l.state, '')) AS name
        FROM t_timed p JOIN t_lines l
          ON p.category IS NOT DISTINCT FROM l.category AND p.state IS NOT DISTINCT FROM l.state
        WHERE slope IS NOT NULL
    ),
    draws AS (SELECT unnest(range(1, 101)) AS draw),
    picked AS (
        SELECT name, draw, avg(b.r) AS up, sum((a.t - t_mean) * b.r) / any_value(sxx) AS turn
        FROM (SELECT name, draw, t, t_mean, sxx,
                     ('0x' || substr(md5(concat_ws('|', name, draw, i)), 1, 8))::BIGINT % n AS taken
              FROM residuals, draws) a
        JOIN (SELECT name, i, r FROM residuals) b USING (name)
        WHERE b.i = a.taken
        GROUP BY name, draw
    ),
    coming AS (
        SELECT category, state, name, n, step, CAST(d1 + INTERVAL 1 MONTH * step AS DATE) AS ds, t_mean,
               date_diff('month', d0, d1) + step AS t, intercept + slope * (date_diff('month', d0, d1) + step) AS yhat
        FROM (SELECT DISTINCT category, state, name, n, d0, d1, t_mean, intercept, slope FROM residuals), range(1, 7) AS s(step)
    )
    SELECT category AS product_category_name, state AS customer_state, ds, round(any_value(yhat), 2) AS yhat,
           round(quantile_cont(seen, 0.1), 2) AS yhat_lower, round(quantile_cont(seen, 0.9), 2) AS yhat_upper
    FROM (
        SELECT c.*, yhat + up + turn * (t - t_mean) + r AS seen
        FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', name, draw, n + step - 1)), 1, 8))::BIGINT % n AS i
              FROM coming, draws) c
        LEFT JOIN picked USING (name, draw)
        LEFT JOIN (SELECT name, i, r FROM residuals) USING (name, i)
    )
    GROUP BY category, state, ds)
"""
_BODIES["o13e_median_exact_delay"] = """
    SELECT n AS rows, round(us / 86400000000.0, 6) AS median_delay
    FROM (SELECT epoch_us(arrived) - epoch_us(promised) AS us, count(*) OVER () AS n,
                 row_number() OVER (ORDER BY epoch_us(arrived) - epoch_us(promised)) AS place
          FROM t_arrivals)
    WHERE place = n // 2 + 1
"""
_BODIES["o14q_payment_quartiles"] = """
    SELECT payment_type, CAST(part AS DOUBLE) AS at, n AS rows, payment_value
    FROM (SELECT event_type AS payment_type, value AS payment_value, count(*) OVER (PARTITION BY event_type) AS n,
                 row_number() OVER (PARTITION BY event_type ORDER BY value NULLS FIRST) - 1 AS place
          FROM events),
         (VALUES (0), (0.25), (0.5), (0.75), (1)) AS v(part)
    WHERE place = least(CAST(floor(part * n) AS BIGINT), n - 1)
"""
_BODIES["o04r_reference_report"] = " UNION ALL ".join(
    f"SELECT '{name}' AS reference, count(*) AS orphans FROM {child} WHERE {key} NOT IN (SELECT {key} FROM {parent})"
    for name, child, key, parent in (
        ("items without order", "t_items", "order_id", "t_orders"),
        ("orders without items", "t_orders", "order_id", "t_items"),
        ("orders without customer", "t_orders", "customer_id", "t_customers"),
        ("customers without orders", "t_customers", "customer_id", "t_orders"),
        ("items without product", "t_items", "product_id", "t_products"),
        ("products never sold", "t_products", "product_id", "t_items"),
        ("items whose order is missing", "t_items", "order_id", "(SELECT * FROM t_orders WHERE order_id % 5 <> 0)"),
    )
)
_BODIES["g13p_kpi_published"] = _BODIES["g13_kpi_fraction"]
_BODIES["g11p_category_by_partition"] = """
    SELECT order_id, buyer_state AS customer_state, km AS "DistanceKM", late1 AS "DeliveryDelayDays",
           CASE WHEN buyer_state < 'M' THEN kind ELSE 'unknown' END AS "DelayCategory"
    FROM t_shipped
"""
_BODIES["d03t_map_tiles"] = """
    SELECT zoom, sum(bits << place)::BIGINT AS tile, any_value(orders) AS "NumberOfOrders",
           any_value(late) AS "Delayed", round(100.0 * any_value(late) / any_value(orders), 2) AS "DelayedPct"
    FROM (SELECT zoom, north, east, orders, late, 2 * i AS place,
                 ((north >> i) & 1) * 2 + ((east >> i) & 1) AS bits
          FROM (SELECT zoom, north, east, count(*) AS orders, count(*) FILTER (WHERE kind = 'Delayed') AS late
                FROM (SELECT kind, zoom::INTEGER AS zoom,
                             least(floor((lat1 + 90) / 180 * pow(2, zoom)), pow(2, zoom) - 1)::BIGINT AS north,
                             least(floor((lng1 + 180) / 360 * pow(2, zoom)), pow(2, zoom) - 1)::BIGINT AS east
                      FROM t_shipped, range(13) AS z(zoom))
                GROUP BY ALL),
               range(12) AS b(i))
    GROUP BY zoom, north, east
"""
_BODIES["s02_import_with_quarantine"] = """
    SELECT reason, count(*) AS lines, CASE WHEN reason = 'good' THEN round(sum(value)::DOUBLE, 2) END AS good_value
    FROM (SELECT CAST(value AS DECIMAL(28, 10)) AS value,
                 CASE WHEN event_id % 101 = 0 THEN 'wrong number of fields'
                      WHEN event_id % 97 = 0 THEN 'value not of its type'
                      WHEN event_id % 83 = 2 OR event_type = '' OR event_type IS NULL THEN 'missing payment_type'
                      WHEN event_id % 89 = 1 OR value IS NULL THEN 'missing payment_value'
                      ELSE 'good' END AS reason
          FROM events)
    GROUP BY reason
"""
_CHANGE_BODIES = {
    "f02c_changing_trend": f"""
        SELECT {_NAMED}, CAST(n AS BIGINT) AS n, strength, round(freedom, 2) AS freedom, round(sigma, 2) AS sigma
        FROM c_models
    """,
    "f04c_changing_forecast": f"""
        SELECT {_NAMED}, ds, {_BOUNDS}
        FROM (SELECT *, yhat - reach AS lo, yhat + reach AS hi FROM c_forecast)
    """,
}

ORACLES: dict[str, str] = {name: _statement(body, _TABLES) for name, body in _BODIES.items()}
for _source, _bodies in (
    ("t_monthly", _SERIES_BODIES),
    ("t_total", _TOTAL_BODIES),
    ("t_every_month", _FILLED_BODIES),
):
    _tables = {**_TABLES, **_trend(_source)}
    ORACLES.update({name: _statement(body, _tables) for name, body in _bodies.items()})
_tables = {**_TABLES, **_waves("t_monthly")}
ORACLES.update({name: _statement(body, _tables) for name, body in _WAVE_BODIES.items()})
_tables = {**_TABLES, **_changes("t_monthly", 4, 0.8, range(-6, 1))}
ORACLES.update({name: _statement(body, _tables) for name, body in _CHANGE_BODIES.items()})
# A rebuilt table holds the same as one that is built once.
for _rebuilt, _plain in (
    ("g11r_category_in_place", "g11_delay_category"),
    ("g13r_kpi_rebuilt", "g13_kpi_fraction"),
    ("f07r_export_replaced", "f07_export"),
):
    ORACLES[_rebuilt] = ORACLES[_plain]
