"""The registered queries once more as plain SQL, written independently of the operators, for another engine to run."""

from __future__ import annotations

#: Views that the statements are built from: name, (views it needs, SQL over the star schema).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "orders_": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS order_date,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(2,2)) AS DECIMAL(12,2)) AS discount_amount,
               CAST(o_totalprice AS DECIMAL(12,2)) + CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(2,2)) AS DECIMAL(12,2)) AS gross_amount
        FROM orders"""),
    "lines_": ((), """
        SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_returnflag DESC) = 1"""),
    "items_": (("lines_",), """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_item_id, CAST(l_orderkey AS VARCHAR) AS order_id,
               CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS INTEGER) AS quantity, l_returnflag, l_shipdate AS shipped,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS discount_amount,
               CAST(l_extendedprice AS DECIMAL(12,2)) - CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS line_total
        FROM lines_"""),
    "returns_": (("items_",), "SELECT order_id, order_item_id, product_id, quantity, line_total AS refund_amount FROM items_ WHERE l_returnflag = 'R'"),
    "product_log_": ((), """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category,
               CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.60 AS DECIMAL(2,2)) AS DECIMAL(10,2)) AS cost, TIMESTAMP '1990-01-01' AS updated_at FROM part
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.70 AS DECIMAL(2,2)) AS DECIMAL(10,2)), TIMESTAMP '1998-01-01' FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.70 AS DECIMAL(2,2)) AS DECIMAL(10,2)), TIMESTAMP '1999-01-01' FROM part WHERE p_partkey % 6 = 0"""),
    "products_": (("product_log_",), """
        SELECT product_id, product_name, category, cost, updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY product_id ORDER BY updated_at) AS valid_to
        FROM (SELECT *, lag(cost) OVER w AS c, lag(product_name) OVER w AS n, lag(category) OVER w AS k, row_number() OVER w AS r
              FROM product_log_ WINDOW w AS (PARTITION BY product_id ORDER BY updated_at))
        WHERE r = 1 OR c IS DISTINCT FROM cost OR n IS DISTINCT FROM product_name OR k IS DISTINCT FROM category"""),
    "customer_log_": ((), """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, n_name AS country, c_mktsegment AS city, TIMESTAMP '1990-01-01' AS updated_at FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), n_name, c_mktsegment, TIMESTAMP '1998-01-01' FROM customer LEFT JOIN nation ON n_nationkey = (c_nationkey + 1) % 25 WHERE c_custkey % 5 = 0"""),
    "customers_": (("customer_log_",), """
        SELECT customer_id, country, city, updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY customer_id ORDER BY updated_at) AS valid_to FROM customer_log_"""),
    "events_": ((), """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_timestamp, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
               CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'checkout_start' ELSE event_type END AS event_type,
               list_extract(['organic', 'paid_search', 'social', 'email', 'direct', 'referral'], TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1) AS utm_source
        FROM events"""),
    "sold_": (("orders_",), "SELECT * FROM orders_ WHERE status IN ('paid', 'shipped', 'delivered') AND order_date IS NOT NULL"),
    "daily_sales": (("sold_",), """
        SELECT CAST(order_date AS DATE) AS date, count(*) AS orders, count(DISTINCT customer_id) AS customers, sum(gross_amount) AS gross_revenue, sum(discount_amount) AS discounts,
               sum(total_amount) AS net_revenue, (CAST(sum(total_amount) * 100 AS BIGINT) * 2 + count(*)) // (2 * count(*)) / 100.0 AS average_order_value FROM sold_ GROUP BY 1"""),
    "sold_lines_": (("items_", "sold_", "products_"), """
        SELECT i.*, s.order_date, p.product_name, p.category, p.cost FROM items_ i JOIN sold_ s USING (order_id)
        LEFT JOIN products_ p ON p.product_id = i.product_id AND p.valid_from <= s.order_date AND (p.valid_to IS NULL OR p.valid_to > s.order_date)"""),
    "product_performance": (("sold_lines_", "returns_"), """
        SELECT s.*, coalesce(r.returned_units, 0) AS returned_units, coalesce(r.refunded_amount, 0) AS refunded_amount, revenue - cost AS profit,
               CASE WHEN revenue > 0 THEN 100.0 * CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) ELSE 0 END AS margin_pct,
               CASE WHEN units_sold > 0 THEN 100.0 * coalesce(r.returned_units, 0) / units_sold ELSE 0 END AS return_rate
        FROM (SELECT product_id, product_name, category, sum(quantity) AS units_sold, sum(line_total) AS revenue, sum(quantity * cost) AS cost, count(DISTINCT order_id) AS orders FROM sold_lines_ GROUP BY ALL) s
        LEFT JOIN (SELECT product_id, sum(quantity) AS returned_units, sum(refund_amount) AS refunded_amount FROM returns_ GROUP BY 1) r USING (product_id)"""),
    "category_performance": (("sold_lines_",), """
        SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS month, count(DISTINCT order_id) AS orders, sum(quantity) AS units_sold, sum(line_total) AS revenue,
               sum(quantity * cost) AS cost, sum(line_total) - sum(quantity * cost) AS profit FROM sold_lines_ GROUP BY 1, 2"""),
    "customer_lifetime_value": (("sold_", "customers_"), """
        SELECT s.*, c.country, (CAST(total_spend * 100 AS BIGINT) * 2 + orders) // (2 * orders) / 100.0 AS average_order_value, date_diff('day', first_order, last_order) AS active_days, total_spend AS lifetime_value
        FROM (SELECT customer_id, count(*) AS orders, sum(total_amount) AS total_spend, CAST(min(order_date) AS DATE) AS first_order, CAST(max(order_date) AS DATE) AS last_order FROM sold_ GROUP BY 1) s
        LEFT JOIN (SELECT * FROM customers_ WHERE valid_to IS NULL) c USING (customer_id)"""),
    "customer_segments": (("customer_lifetime_value",), """
        SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN f_score >= 4 AND r_score >= 3 THEN 'Loyal'
                       WHEN m_score >= 4 AND r_score >= 3 THEN 'Big Spenders' WHEN r_score >= 4 AND f_score <= 2 THEN 'Promising'
                       WHEN r_score <= 2 AND (f_score >= 3 OR m_score >= 3) THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating'
                       WHEN r_score = 3 THEN 'Needs Attention' ELSE 'Others' END AS segment
        FROM (SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r_score, ntile(5) OVER (ORDER BY orders, customer_id) AS f_score, ntile(5) OVER (ORDER BY total_spend, customer_id) AS m_score
              FROM (SELECT *, date_diff('day', last_order, (SELECT max(last_order) FROM customer_lifetime_value)) AS recency_days FROM customer_lifetime_value))"""),
    "marketing_funnel": (("events_",), """
        SELECT *, CASE WHEN page_views > 0 THEN 100.0 * add_to_carts / page_views ELSE 0 END AS cart_rate, CASE WHEN add_to_carts > 0 THEN 100.0 * checkouts / add_to_carts ELSE 0 END AS checkout_rate,
               CASE WHEN checkouts > 0 THEN 100.0 * purchases / checkouts ELSE 0 END AS payment_rate, CASE WHEN page_views > 0 THEN 100.0 * purchases / page_views ELSE 0 END AS conversion_rate
        FROM (SELECT CAST(event_timestamp AS DATE) AS date, utm_source AS channel, count(DISTINCT session_id) AS sessions,
                     count(DISTINCT CASE WHEN event_type = 'page_view' THEN session_id END) AS page_views, count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN session_id END) AS add_to_carts,
                     count(DISTINCT CASE WHEN event_type = 'checkout_start' THEN session_id END) AS checkouts, count(DISTINCT CASE WHEN event_type = 'purchase' THEN session_id END) AS purchases
              FROM events_ WHERE event_timestamp IS NOT NULL GROUP BY 1, 2)"""),
    "raw_": ((), """
        SELECT CAST(event_id AS VARCHAR) AS order_id, CASE CAST(event_id AS BIGINT) % 7 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS order_date,
               ' ' || upper(event_type) || ' ' AS status, CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR) END AS total_amount, event_id FROM events"""),
    "dq_": (("orders_",), """
        SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 50 = 0 THEN NULL WHEN CAST(order_id AS BIGINT) % 50 = 1 THEN 'CUS-404' ELSE customer_id END AS customer_id, order_date,
               CASE WHEN CAST(order_id AS BIGINT) % 40 = 3 THEN 'unknown' ELSE status END AS status,
               CASE WHEN CAST(order_id AS BIGINT) % 60 = 7 THEN -total_amount ELSE total_amount END AS total_amount, gross_amount, discount_amount FROM orders_
        UNION ALL SELECT order_id, customer_id, order_date, status, total_amount, gross_amount, discount_amount FROM orders_ WHERE CAST(order_id AS BIGINT) % 500 = 2"""),
    "features_": (("sold_", "returns_"), """
        SELECT customer_id, date_diff('day', last_day, DATE '2001-02-01') AS recency_days, frequency, monetary, (CAST(monetary * 100 AS BIGINT) * 2 + frequency) // (2 * frequency) / 100.0 AS avg_order_value,
               date_diff('day', first_day, DATE '2001-02-01') AS tenure_days, orders_last_30d, orders_last_90d, spend_last_90d,
               CASE WHEN frequency > 1 THEN date_diff('day', first_day, last_day) / CAST(frequency - 1 AS DOUBLE) ELSE CAST(date_diff('day', first_day, DATE '2001-02-01') AS DOUBLE) END AS avg_days_between_orders,
               100.0 * coalesce(n, 0) / frequency AS return_rate
        FROM (SELECT customer_id, count(*) AS frequency, sum(total_amount) AS monetary, CAST(min(order_date) AS DATE) AS first_day, CAST(max(order_date) AS DATE) AS last_day,
                     count(*) FILTER (WHERE CAST(order_date AS DATE) > DATE '2001-01-02') AS orders_last_30d, count(*) FILTER (WHERE CAST(order_date AS DATE) > DATE '2000-11-03') AS orders_last_90d,
                     coalesce(sum(total_amount) FILTER (WHERE CAST(order_date AS DATE) > DATE '2000-11-03'), 0) AS spend_last_90d
              FROM sold_ WHERE CAST(order_date AS DATE) <= DATE '2001-02-01' GROUP BY 1)
        LEFT JOIN (SELECT customer_id, count(DISTINCT order_id) AS n FROM sold_ JOIN (SELECT DISTINCT order_id FROM returns_) USING (order_id) WHERE CAST(order_date AS DATE) <= DATE '2001-02-01' GROUP BY 1) USING (customer_id)"""),
    "label_": (("sold_",), """
        SELECT customer_id, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS churned FROM (SELECT DISTINCT customer_id FROM sold_ WHERE CAST(order_date AS DATE) <= DATE '2001-02-01')
        LEFT JOIN (SELECT DISTINCT customer_id, 1 AS b FROM sold_ WHERE CAST(order_date AS DATE) > DATE '2001-02-01' AND CAST(order_date AS DATE) <= DATE '2001-05-02') USING (customer_id)"""),
    "baseline_": (("features_", "label_"), "SELECT *, CAST(recency_days AS DOUBLE) / (SELECT max(recency_days) FROM features_ JOIN label_ USING (customer_id)) AS churn_probability FROM features_ JOIN label_ USING (customer_id)"),
}


#: The reports once more, from views of the marts or straight from the orders.
REPORTS: dict[str, tuple[tuple[str, ...], str]] = {
    "kpis": (("sold_", "daily_sales"), """
        SELECT count(DISTINCT CAST(order_date AS DATE)) AS days, count(*) AS orders, sum(total_amount) AS net_revenue, sum(discount_amount) AS discounts,
               (SELECT round(avg(average_order_value), 2) FROM daily_sales) AS average_ticket, CAST(min(order_date) AS DATE) AS first_day, CAST(max(order_date) AS DATE) AS last_day FROM sold_"""),
    "reconciliation": (("sold_",), "SELECT s AS gold_revenue, s AS silver_revenue, 0 AS difference FROM (SELECT sum(total_amount) AS s FROM sold_)"),
    "best_days": (("daily_sales",), "SELECT * FROM daily_sales QUALIFY rank() OVER (ORDER BY net_revenue DESC, date) <= 10"),
    "rfm_composition": (("customer_segments",), """
        SELECT segment, n AS customers, round(100.0 * n / (SELECT count(*) FROM customer_segments), 1) AS pct_of_base, round(a, 2) AS average_spend, s AS total_spend, round(o, 1) AS average_orders, round(r) AS average_recency
        FROM (SELECT segment, count(customer_id) AS n, avg(total_spend) AS a, sum(total_spend) AS s, avg(orders) AS o, avg(recency_days) AS r FROM customer_segments GROUP BY ALL)"""),
    "revenue_concentration": (("customer_lifetime_value",), """
        SELECT band, count(*) AS customers, sum(total_spend) AS revenue, round(100.0 * sum(total_spend) / (SELECT sum(total_spend) FROM customer_lifetime_value), 1) AS pct_of_revenue
        FROM (SELECT total_spend, rank() OVER (ORDER BY total_spend DESC, customer_id) AS r FROM customer_lifetime_value)
        JOIN (VALUES ('01 - top 1%', 0.00, 0.01), ('02 - top 5%', 0.01, 0.05), ('03 - top 20%', 0.05, 0.20), ('04 - top 50%', 0.20, 0.50), ('05 - rest', 0.50, 1.00)) b(band, low, high)
          ON r > low * (SELECT count(*) FROM customer_lifetime_value) AND r <= high * (SELECT count(*) FROM customer_lifetime_value) GROUP BY band"""),
    "value_by_country": (("customer_lifetime_value",), "SELECT country, count(*) AS customers, sum(lifetime_value) AS revenue, round(avg(average_order_value), 2) AS average_ticket FROM customer_lifetime_value GROUP BY country HAVING country IS NOT NULL"),
    "at_risk_top": (("customer_segments",), "SELECT * FROM (FROM customer_segments WHERE segment = 'At Risk') QUALIFY rank() OVER (ORDER BY total_spend DESC, customer_id) <= 20"),
    "funnel_steps": (("marketing_funnel",), """
        SELECT step, sessions, place FROM (UNPIVOT (SELECT sum(page_views) AS a, sum(add_to_carts) AS b, sum(checkouts) AS c, sum(purchases) AS d FROM marketing_funnel) ON a, b, c, d INTO NAME k VALUE sessions)
        JOIN (VALUES ('a', 'page views', 1), ('b', 'added to cart', 2), ('c', 'started checkout', 3), ('d', 'purchased', 4)) s(k, step, place) USING (k)"""),
    "funnel_by_channel": (("marketing_funnel",), """
        SELECT channel, v AS visits, p AS purchases, round(100.0 * a / nullif(v, 0), 1) AS pct_to_cart, round(100.0 * c / nullif(a, 0), 1) AS pct_to_checkout, round(100.0 * p / nullif(c, 0), 1) AS pct_paid, round(100.0 * p / nullif(v, 0), 2) AS conversion
        FROM (SELECT channel, sum(page_views) AS v, sum(add_to_carts) AS a, sum(checkouts) AS c, sum(purchases) AS p FROM marketing_funnel GROUP BY ALL)"""),
    "weekly_conversion": (("marketing_funnel",), """
        SELECT week, v AS visits, p AS purchases, round(100.0 * p / nullif(v, 0), 2) AS conversion_pct
        FROM (SELECT date - CAST(isodow(date) - 1 AS INTEGER) AS week, sum(page_views) AS v, sum(purchases) AS p FROM marketing_funnel GROUP BY 1) QUALIFY rank() OVER (ORDER BY week DESC) <= 20"""),
    "funnel_losses": (("marketing_funnel",), """
        SELECT v - a AS lost_before_cart, a - c AS lost_before_checkout, c - p AS lost_before_payment FROM (SELECT sum(page_views) AS v, sum(add_to_carts) AS a, sum(checkouts) AS c, sum(purchases) AS p FROM marketing_funnel)"""),
    "top_products": (("product_performance",), "SELECT * REPLACE (round(margin_pct, 1) AS margin_pct), round(return_rate, 1) AS return_pct FROM (FROM product_performance QUALIFY rank() OVER (ORDER BY revenue DESC, product_id) <= 20)"),
    "low_margin": (("product_performance",), "SELECT * REPLACE (round(margin_pct, 1) AS margin_pct) FROM (FROM product_performance WHERE units_sold > 0 QUALIFY rank() OVER (ORDER BY revenue DESC, margin_pct, product_id) <= 15)"),
    "high_returns": (("product_performance",), "SELECT *, round(return_rate, 1) AS return_pct FROM (FROM product_performance WHERE units_sold >= 5 QUALIFY rank() OVER (ORDER BY return_rate DESC, product_id) <= 15)"),
    "category_months": (("category_performance",), "SELECT *, CASE WHEN revenue <> 0 THEN round(100.0 * (revenue - cost) / revenue, 1) END AS margin_pct FROM category_performance"),
    "category_growth": (("category_performance",), """
        SELECT c.category, c.month, c.revenue, p.revenue AS previous_month, CASE WHEN p.revenue <> 0 THEN round(100.0 * (c.revenue - p.revenue) / p.revenue, 1) END AS growth_pct
        FROM category_performance c ASOF LEFT JOIN category_performance p ON c.category IS NOT DISTINCT FROM p.category AND c.month > p.month"""),
    "dashboard_kpis": (("sold_", "daily_sales"), "SELECT sum(total_amount) AS net_revenue, count(*) AS orders, (SELECT round(avg(average_order_value), 2) FROM daily_sales) AS average_ticket, count(DISTINCT customer_id) AS customers FROM sold_"),
    "dashboard_daily": (("sold_",), "SELECT CAST(order_date AS DATE) AS date, sum(total_amount) AS net_revenue, count(*) AS orders, count(DISTINCT customer_id) AS customers FROM sold_ GROUP BY 1"),
    "dashboard_country": (("sold_", "customers_"), "SELECT c.country, sum(s.total_amount) AS revenue, count(DISTINCT s.customer_id) AS customers FROM sold_ s JOIN customers_ c ON c.customer_id = s.customer_id AND c.valid_to IS NULL AND c.country IS NOT NULL GROUP BY 1"),
    "dashboard_segments": (("customer_segments",), "SELECT DISTINCT segment, count(*) OVER w AS customers, sum(total_spend) OVER w AS revenue FROM customer_segments WINDOW w AS (PARTITION BY segment)"),
    "dashboard_products": (("product_performance",), "SELECT * REPLACE (round(margin_pct, 1) AS margin_pct), round(return_rate, 1) AS return_pct FROM product_performance QUALIFY rank() OVER (ORDER BY revenue DESC, product_id) <= 20"),
    "dashboard_funnel": (("marketing_funnel",), "SELECT channel, sum(page_views) AS visits, sum(add_to_carts) AS added, sum(checkouts) AS checkouts, sum(purchases) AS purchases, CASE WHEN sum(page_views) > 0 THEN round(100.0 * sum(purchases) / sum(page_views), 2) END AS conversion_pct FROM marketing_funnel GROUP BY ALL"),
    "bench_daily_total": (("sold_",), "SELECT sum(total_amount) AS revenue, count(DISTINCT CAST(order_date AS DATE)) AS days FROM sold_"),
    "bench_daily_window": (("sold_",), "SELECT sum(total_amount) AS revenue FROM sold_ WHERE strftime(order_date, '%Y-%m') IN ('1997-06', '1997-07', '1997-08')"),
    "bench_orders_range": (("orders_",), "SELECT count(*) AS orders, sum(total_amount) AS amount FROM orders_ WHERE strftime(order_date, '%Y-%m') IN ('1997-06', '1997-07', '1997-08')"),
    "bench_event_sessions": (("events_",), "SELECT event_type, count(session_id) AS sessions FROM (SELECT DISTINCT event_type, session_id FROM events_) GROUP BY 1"),
}


def with_views(names: tuple[str, ...], select: str) -> str:
    """The statement with the views it needs before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in VIEWS[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    views = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {views}\n{select}" if views else select
