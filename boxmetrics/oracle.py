"""The same results as plain SQL over the Parquet tables, for comparison in DuckDB.

The SQL works row by row: it joins every usage row to its dimensions and aggregates once.
It shares no step with the Spark plans, which count first and join afterwards. Sums run
over decimals and are cast to double, then divided, so both sides give the same digits.
"""

from __future__ import annotations

_SOURCE = """
parts AS (
    SELECT p_partkey, p_type, p_size,
           CASE WHEN p_size <= 12 THEN 'P-S' WHEN p_size <= 25 THEN 'P-M'
                WHEN p_size <= 40 THEN 'P-L' ELSE 'P-XL' END AS size_class,
           CASE WHEN p_size <= 12 THEN 'Small Box' WHEN p_size <= 25 THEN 'Medium Box'
                WHEN p_size <= 40 THEN 'Large Box' ELSE 'Extra Large' END AS class_name
    FROM part),
market_orders AS (
    SELECT o_orderkey, o_orderdate, o_totalprice,
           CASE r_name WHEN 'AFRICA' THEN 'DE' WHEN 'EUROPE' THEN 'DE'
                       WHEN 'AMERICA' THEN 'UK' WHEN 'ASIA' THEN 'NL' ELSE 'FR' END AS market
    FROM orders, customer, nation, region
    WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey),
mean_boxes AS (
    SELECT size_class, class_name, p_type, sum(p_size) * 500 // count(p_size) AS cm2
    FROM parts
    GROUP BY size_class, class_name, p_type),
box AS (
    SELECT size_class || CASE p_type WHEN 'STANDARD' THEN '' ELSE '/' || p_type END AS pkg_id,
           class_name || CASE p_type WHEN 'STANDARD' THEN '' ELSE ' ' || p_type END AS pkg_name,
           p_type AS material_type,
           CASE size_class WHEN 'P-M' THEN CAST(cm2 AS DECIMAL(12, 4))
                ELSE CAST(cm2 * 0.0001 AS DECIMAL(12, 4)) END AS raw_area,
           CASE size_class WHEN 'P-M' THEN 'cm2' ELSE 'm2' END AS unit,
           CAST(cm2 * 0.0001 AS DECIMAL(12, 4)) AS area,
           CASE size_class WHEN 'P-XL' THEN 'Discontinued' ELSE 'Active' END AS status
    FROM mean_boxes),
std AS (
    SELECT DISTINCT CASE size_class WHEN 'P-S' THEN 2 WHEN 'P-M' THEN 4
                    WHEN 'P-L' THEN 6 ELSE 8 END AS meals_count,
           size_class AS recommended_pkg_id
    FROM parts),
quarters AS (
    SELECT market,
           CAST(date_trunc('quarter', DATE '2025-01-01'
                + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 730 AS INTEGER))
                AS DATE) AS first_day,
           sum(CAST(round(o_totalprice * 100) AS BIGINT)) // (count(*) * 200000) AS hundredths
    FROM market_orders
    GROUP BY ALL),
rate AS (
    SELECT market,
           CASE market WHEN 'DE' THEN 'Recycled Paper' ELSE 'Corrugated' END AS material_type,
           CAST(hundredths * 0.01 AS DECIMAL(12, 4)) AS local_rate,
           CASE market WHEN 'UK' THEN 'GBP' ELSE 'EUR' END AS currency,
           CASE market WHEN 'UK' THEN CAST(hundredths * 0.0117 AS DECIMAL(12, 4))
                ELSE CAST(hundredths * 0.01 AS DECIMAL(12, 4)) END AS eur,
           first_day AS valid_from,
           CASE first_day WHEN DATE '2026-10-01' THEN DATE '9999-12-31'
                ELSE CAST(first_day + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS valid_to
    FROM quarters),
usage AS (
    SELECT DISTINCT l_orderkey * 10 + l_linenumber AS order_id, market,
           CASE WHEN l_partkey % 37 <> 0
                THEN size_class || CASE p_type WHEN 'STANDARD' THEN '' ELSE '/' || p_type END
           END AS pkg_id,
           CASE CAST(l_quantity AS INTEGER) % 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 8 ELSE 2
           END AS meals_count,
           DATE '2025-01-01'
               + CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 730 AS INTEGER)
               AS order_date,
           CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS is_damaged
    FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_partkey % 50 = 0) l
    JOIN market_orders ON l_orderkey = o_orderkey
    JOIN parts ON l_partkey = p_partkey)
"""

# Joins. Each adds one table to usage `u`: box `b`, standard `s`, recommended box `r`,
# rate `k`.
_BOX = " JOIN box b ON b.pkg_id = u.pkg_id"
_STANDARD = " LEFT JOIN std s ON s.meals_count = u.meals_count"
_ANY_REC = _STANDARD + " LEFT JOIN box r ON r.pkg_id = s.recommended_pkg_id"
_REC = (
    " JOIN std s ON s.meals_count = u.meals_count JOIN box r ON r.pkg_id = s.recommended_pkg_id"
)
_RATE = " JOIN rate k ON k.market = u.market AND u.order_date BETWEEN k.valid_from AND k.valid_to"
_PRICED = "usage u" + _BOX + _ANY_REC + _RATE

_QUARTER = "u.order_date BETWEEN DATE '2026-01-01' AND DATE '2026-03-31'"

_COST = "(b.area * k.eur)"
_IDEAL = "(r.area * k.eur)"
_IDEAL_OR_COST = "(coalesce(r.area, b.area) * k.eur)"
_WASTE = "greatest(b.area - coalesce(r.area, b.area), 0.0000)"
_OVER = "b.area > r.area"


def _double(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def _total(value: str) -> str:
    return _double(f"sum({value})")


def _mean(value: str) -> str:
    return f"{_total(value)} / count({value})"


def _count_of(value: str) -> str:
    return f"CAST(sum({value}) AS BIGINT)"


def _mean_ratio(value: str) -> str:
    """The exact average: a double is a whole number of 2**-26 and a rest of 2**-40 of these."""
    scaled = f"({value} * 67108864)"
    high = f"sum(CAST(floor({scaled}) AS HUGEINT))"
    low = f"sum(CAST(floor(({scaled} - floor({scaled})) * 1099511627776) AS HUGEINT))"
    return f"({_double(high)} + {_double(low)} / 1099511627776) / 67108864 / count({value})"


def _pct(part: str, whole: str) -> str:
    return f"{part} / nullif({whole}, 0) * 100"


_EFFICIENCY = f"({_double('r.area')} / {_double('b.area')} * 100)"
_FIT_RATIO = f"({_double('b.area')} / {_double('r.area')})"
_DAMAGE = f"{_count_of('u.is_damaged')}"
_DAMAGE_PCT = f"{_total('u.is_damaged')} * 100.0 / count(u.order_id)"
_OVER_COUNT = f"CAST(count(*) FILTER ({_OVER}) AS BIGINT)"
_OVER_PCT = f"{_double(f'count(*) FILTER ({_OVER})')} / count(u.order_id) * 100"

_GRADED = (
    "CASE WHEN b.area = r.area THEN 'Perfect Fit' WHEN b.area < r.area THEN 'Under-boxed' "
    "WHEN b.area * 10 <= r.area * 12 THEN 'Slight Over-box' "
    "WHEN b.area * 10 <= r.area * 15 THEN 'Moderate Over-box' ELSE 'Severe Over-box' END"
)
_PLAIN_FIT = (
    "CASE WHEN s.recommended_pkg_id IS NULL THEN 'Unknown (no standard)' "
    "WHEN b.raw_area = coalesce(r.area, b.area) THEN 'Perfect Fit' "
    "WHEN b.area > r.area THEN 'Over-boxed' ELSE 'Under-boxed' END"
)


def _level(pkg_id: str) -> str:
    """Place of a box, or of the box it is a variant of, in the size order."""
    return f"list_position(['P-S', 'P-M', 'P-L', 'P-XL'], split_part({pkg_id}, '/', 1))"


def _parts_of_overspend() -> dict[str, str]:
    return {
        "actual_cost_eur": "b.area * 1.75",
        "ideal_cost_eur": "r.area * 1.75",
        "counterfactual_cost_eur": "b.area * 1.15",
        "price_hike_impact_eur": "b.area * 0.60",
        "overboxing_impact_eur": f"{_WASTE} * 1.75",
        "total_overspend_vs_ideal_eur": "(b.area - r.area) * 1.75 + r.area * 0.60",
    }


_DE_QUARTER = f"usage u{_BOX}{_REC} WHERE u.market = 'DE' AND {_QUARTER}"
_PAIRED = (
    f"usage u{_BOX}{_REC}{_RATE} JOIN usage p ON p.order_id = u.order_id AND p.pkg_id IS NOT NULL"
)


def _damage_by(label: str, grouping: str = "") -> str:
    return (
        f"SELECT {label} AS dimension, count(order_id) AS total_orders, "
        "CAST(sum(is_damaged) AS BIGINT) AS damaged_orders, "
        f"{_total('is_damaged')} * 100.0 / count(order_id) AS damage_rate_pct "
        f"FROM fitted {grouping}"
    )


def reports() -> dict[str, str]:
    """Queries over the relations `box`, `std`, `rate` and `usage`, without a WITH clause."""
    overspend = _parts_of_overspend()
    sums = {name: f"sum({value})" for name, value in overspend.items()}
    price, size = _double(sums["price_hike_impact_eur"]), _double(sums["overboxing_impact_eur"])
    wasted = f"({_WASTE} * k.eur)"
    efficiency_of_sums = _pct(_total(_IDEAL_OR_COST), _total(_COST))
    no_standard = f"usage u{_STANDARD} WHERE s.recommended_pkg_id IS NULL AND u.pkg_id IS NOT NULL"
    discontinued = f"usage u{_BOX} WHERE b.status = 'Discontinued'"
    repeated = "SELECT order_id FROM usage GROUP BY order_id HAVING count(*) > 1"
    on_day = "DATE '2026-01-01' BETWEEN valid_from AND valid_to"
    return {
        "t_dim_packaging_master": f"""
            SELECT pkg_id, pkg_name, material_type, {_double('raw_area')} AS surface_area,
                   unit AS unit_of_measure, {_double('area')} AS surface_area_m2_normalised, status
            FROM box""",
        "t_dim_packaging_standards": "SELECT meals_count, recommended_pkg_id FROM std",
        "t_dim_procurement_cost": f"""
            SELECT market, material_type, {_double('local_rate')} AS cost_per_m2, currency,
                   {_double('eur')} AS cost_per_m2_eur, valid_from, valid_to
            FROM rate""",
        "t_fact_box_usage": "SELECT * FROM usage",
        "q01a_duplicate_orders": """
            SELECT order_id, count(*) AS occurrence_count, min(order_date) AS order_date,
                   max(market) AS market, max(pkg_id) AS pkg_id
            FROM usage GROUP BY order_id HAVING count(*) > 1""",
        "q01b_null_pkg": """
            SELECT order_id, market, meals_count, order_date, is_damaged
            FROM usage WHERE pkg_id IS NULL""",
        "q01c_discontinued_in_use": f"""
            SELECT u.order_id, u.market, u.pkg_id, b.pkg_name, b.status, u.meals_count, u.order_date
            FROM {discontinued}""",
        "q01d_meals_without_standard": f"""
            SELECT u.order_id, u.market, u.pkg_id, u.meals_count, u.order_date, s.recommended_pkg_id
            FROM {no_standard}""",
        "q01e_audit_summary": f"""
            SELECT * FROM (VALUES
                ('Duplicate order IDs', (SELECT count(*) FROM ({repeated}))),
                ('Null pkg_id orders', (SELECT count(*) FROM usage WHERE pkg_id IS NULL)),
                ('Discontinued box in active use', (SELECT count(*) FROM {discontinued})),
                ('Meal count not in standards table', (SELECT count(*) FROM {no_standard}))
            ) AS found(issue_type, affected_records)""",
        "q02_total_cost_per_market": f"""
            SELECT u.market, count(u.order_id) AS order_count, {_total('b.area')} AS total_surface_m2,
                   {_mean('k.eur')} AS avg_rate_eur_per_m2, {_total(_COST)} AS total_cost_eur,
                   {_mean(_COST)} AS avg_order_cost_eur, {_DAMAGE} AS damaged_orders,
                   ((2000 * {_DAMAGE} + count(u.order_id)) // (2 * count(u.order_id))) / 10.0
                       AS damage_rate_pct
            FROM usage u{_BOX}{_RATE} WHERE {_QUARTER} GROUP BY u.market""",
        "q03a_overboxing_detail": f"""
            SELECT u.order_id, u.market, u.pkg_id AS actual_pkg, b.pkg_name AS actual_pkg_name,
                   s.recommended_pkg_id, r.pkg_name AS recommended_pkg_name, u.meals_count,
                   u.order_date, {_double('b.area')} AS actual_area_m2,
                   {_double('r.area')} AS recommended_area_m2, {_double(_WASTE)} AS waste_m2,
                   {_FIT_RATIO} AS fit_ratio,
                   {_level('p.pkg_id')} - {_level('s.recommended_pkg_id')} AS overbox_levels,
                   {_GRADED} AS fit_category, {_double('k.eur')} AS cost_per_m2_eur,
                   {_double(_COST)} AS actual_cost_eur, {_double(_IDEAL)} AS ideal_cost_eur,
                   {_double(wasted)} AS cost_inefficiency_eur, u.is_damaged
            FROM {_PAIRED}""",
        "q03b_overboxing_by_market": f"""
            SELECT u.market, count(*) AS total_orders, {_OVER_COUNT} AS overboxed_orders,
                   {_total(_WASTE)} AS total_paper_waste_m2,
                   {_total(wasted)} AS total_cost_inefficiency_eur,
                   {_mean_ratio(_FIT_RATIO)} AS avg_fit_ratio,
                   round({_pct(_total(wasted), _total(_COST))}, 1) AS pct_spend_wasted
            FROM {_PAIRED} GROUP BY u.market""",
        "q04a_cost_decomposition": f"""
            SELECT u.order_id, u.pkg_id, s.recommended_pkg_id, u.meals_count, u.order_date,
                   {_double('b.area')} AS actual_area_m2, {_double('r.area')} AS recommended_area_m2,
                   {', '.join(f'{_double(value)} AS {name}' for name, value in overspend.items())}
            FROM {_DE_QUARTER}""",
        "q04b_attribution_totals": f"""
            SELECT {_double(sums['actual_cost_eur'])} AS total_actual_eur,
                   {_double(sums['ideal_cost_eur'])} AS total_ideal_eur,
                   {_double(sums['counterfactual_cost_eur'])} AS total_counterfactual_eur,
                   {price} AS total_price_hike_impact_eur, {size} AS total_overboxing_impact_eur,
                   {_pct(price, f'({price} + {size})')} AS pct_price_hike,
                   {_pct(size, f'({price} + {size})')} AS pct_overboxing
            FROM {_DE_QUARTER}""",
        "q05a_cost_per_meal": f"""
            SELECT u.order_id, u.market, u.pkg_id, b.pkg_name, s.recommended_pkg_id, u.meals_count,
                   u.order_date, {_double('b.area')} AS actual_area_m2,
                   {_double('r.area')} AS recommended_area_m2, {_double('k.eur')} AS cost_per_m2_eur,
                   {_double(_COST)} AS actual_cost_eur, {_double(_IDEAL)} AS ideal_cost_eur,
                   {_double(_COST)} / u.meals_count AS actual_cpm_eur,
                   {_double(_IDEAL)} / u.meals_count AS ideal_cpm_eur,
                   {_double('(b.area - coalesce(r.area, b.area)) * k.eur')} / u.meals_count
                       AS cpm_premium_eur,
                   {_EFFICIENCY} AS efficiency_pct, u.is_damaged
            FROM {_PRICED}""",
        "q05b_overall_cpm": f"""
            SELECT {_total(_COST)} / {_count_of('u.meals_count')} AS overall_actual_cpm_eur,
                   {_total(_IDEAL)} / {_count_of('u.meals_count')} AS overall_ideal_cpm_eur
            FROM {_PRICED} WHERE r.area IS NOT NULL""",
        "q05c_cpm_by_market": f"""
            SELECT u.market, count(u.order_id) AS orders, {_count_of('u.meals_count')} AS total_meals,
                   {_total(_COST)} AS total_actual_cost_eur,
                   {_total(_COST)} / {_count_of('u.meals_count')} AS actual_cpm_eur,
                   {_total(_IDEAL)} / {_count_of('u.meals_count')} AS ideal_cpm_eur,
                   {_mean_ratio(_EFFICIENCY)} AS avg_efficiency_pct
            FROM {_PRICED} GROUP BY u.market""",
        "q05d_cpm_waste_scenario": f"""
            SELECT volume AS scenario_orders_per_month, volume * paid AS actual_monthly_cost_eur,
                   volume * ideal AS ideal_monthly_cost_eur,
                   volume * (paid - ideal) AS monthly_waste_eur
            FROM (SELECT {_mean(_COST)} AS paid, {_mean(_IDEAL)} AS ideal FROM {_PRICED}
                  WHERE u.market = 'DE' AND u.pkg_id = 'P-L' AND u.meals_count = 2),
                 (SELECT unnest([100, 500, 1000, 5000, 10000]) AS volume)""",
        "q06a_material_summary": f"""
            SELECT b.material_type, count(u.order_id) AS total_orders,
                   {_total(_COST)} AS total_actual_cost_eur, {_mean(_COST)} AS avg_order_cost_eur,
                   {_total(_WASTE)} AS total_paper_waste_m2, {_mean(_WASTE)} AS avg_waste_per_order_m2,
                   {_DAMAGE} AS damaged_orders, {_DAMAGE_PCT} AS damage_rate_pct,
                   {_mean_ratio(_EFFICIENCY)} AS avg_efficiency_pct,
                   {_total(_COST)} AS total_cost_inefficiency_eur
            FROM {_PRICED} GROUP BY b.material_type""",
        "q06b_material_by_market": f"""
            SELECT b.material_type, u.market, count(u.order_id) AS orders,
                   {_total(_COST)} AS total_cost_eur, {_total(_WASTE)} AS total_waste_m2,
                   {_DAMAGE} AS damaged, {_mean_ratio(_EFFICIENCY)} AS avg_efficiency_pct
            FROM {_PRICED} GROUP BY b.material_type, u.market""",
        "q06c_same_box_price": f"""
            SELECT u.order_date AS year, u.market, u.pkg_id, b.material_type,
                   {_double('k.eur')} AS rate_local, k.currency, {_double('k.eur')} AS rate_eur_per_m2,
                   {_double(_COST)} AS cost_per_order_eur
            FROM usage u{_BOX}{_RATE} WHERE u.market = 'DE' AND u.pkg_id = 'P-S'""",
        "q07a_market_scorecard": f"""
            SELECT *, (cost_efficiency_pct + (100 - damage_rate_pct) + (100 - overboxing_rate_pct))
                      / 3.0 AS overall_health_index_pct
            FROM (SELECT u.market, count(u.order_id) AS total_orders,
                         {_count_of('u.meals_count')} AS total_meals,
                         {_total(_COST)} AS total_actual_cost_eur,
                         {_total(_IDEAL_OR_COST)} AS total_ideal_cost_eur,
                         {efficiency_of_sums} AS cost_efficiency_pct,
                         {_total(_WASTE)} AS total_paper_waste_m2,
                         {_mean(_WASTE)} AS avg_waste_per_order_m2, {_OVER_COUNT} AS overboxed_orders,
                         {_OVER_PCT} AS overboxing_rate_pct, {_DAMAGE} AS damaged_orders,
                         {_DAMAGE_PCT} AS damage_rate_pct
                  FROM {_PRICED} GROUP BY u.market)""",
        "q07b_box_by_market": f"""
            SELECT u.market, u.pkg_id, count(u.order_id) AS orders, {_total(_COST)} AS total_cost_eur,
                   {_mean(_COST)} AS avg_cost_eur, {_total(_WASTE)} AS total_waste_m2,
                   {_DAMAGE} AS damaged, {efficiency_of_sums} AS efficiency_pct
            FROM {_PRICED} GROUP BY u.market, u.pkg_id""",
        "q08a_damage_rate": f"""
            , fitted AS (SELECT u.*, b.pkg_name, {_PLAIN_FIT} AS fit FROM usage u{_BOX}{_ANY_REC})
            {_damage_by("'Overall'")}
            UNION ALL {_damage_by("concat('Market: ', market)", "GROUP BY market")}
            UNION ALL {_damage_by("concat('Box: ', pkg_id, ' (', pkg_name, ')')", "GROUP BY pkg_id, pkg_name")}
            UNION ALL {_damage_by("concat('Fit: ', fit)", "GROUP BY fit")}""",
        "q08e_damage_detail": f"""
            SELECT u.order_id, u.market, u.pkg_id, b.pkg_name, b.material_type, u.meals_count,
                   u.order_date, {_PLAIN_FIT} AS fit_category, {_double('b.area')} AS actual_area_m2,
                   {_double('r.area')} AS recommended_area_m2, u.is_damaged
            FROM usage u{_BOX}{_ANY_REC} WHERE u.is_damaged = 1""",
        "q09a_yoy_cost": f"""
            SELECT u.market, CAST(year(u.order_date) AS INTEGER) AS yr, count(u.order_id) AS orders,
                   {_mean('k.eur')} AS avg_rate_eur_per_m2, {_mean(_COST)} AS avg_order_cost_eur,
                   {_total(_COST)} AS total_cost_eur
            FROM usage u{_BOX}{_RATE} GROUP BY u.market, year(u.order_date)""",
        "q09b_same_box_yoy": f"""
            SELECT CAST(year(u.order_date) AS INTEGER) AS yr, u.market, u.pkg_id, b.material_type,
                   {_double('k.eur')} AS rate_eur_per_m2,
                   {_double('b.area')} AS surface_area_m2_normalised,
                   {_double(_COST)} AS order_cost_eur,
                   {_double(_COST)} / u.meals_count AS cost_per_meal_eur
            FROM usage u{_BOX}{_RATE} WHERE u.market = 'DE' AND u.pkg_id = 'P-S'""",
        "q09c_rate_change": f"""
            SELECT market, {_double('old')} AS rate_2025_eur, {_double('new')} AS rate_2026_eur,
                   {_double('new - old')} / nullif({_double('old')}, 0) * 100 AS yoy_rate_change_pct
            FROM (SELECT u.market, min(k.eur) FILTER (year(u.order_date) = 2025) AS old,
                         min(k.eur) FILTER (year(u.order_date) = 2026) AS new
                  FROM usage u{_BOX}{_RATE} GROUP BY u.market)
            WHERE old IS NOT NULL AND new IS NOT NULL""",
        "q10a_rate_benchmark": f"""
            SELECT market, material_type, {_double('eur')} AS rate_eur_per_m2, valid_from, valid_to
            FROM rate""",
        "q10b_market_premium": f"""
            SELECT 'DE vs ' || o.market || CASE o.currency WHEN 'GBP' THEN ' (GBP converted)' ELSE '' END
                       AS comparison,
                   {_double('d.eur - o.eur')} AS rate_difference_eur,
                   {_double('d.eur - o.eur')} / {_double('o.eur')} * 100 AS de_premium_pct
            FROM (SELECT max(eur) AS eur FROM rate WHERE market = 'DE' AND {on_day}) d,
                 (SELECT * FROM rate WHERE market <> 'DE' AND {on_day}) o""",
        "q10c_rate_negotiation": f"""
            SELECT {_double('target')} AS target_rate_eur_per_m2,
                   {_double('1.75 - target')} AS saving_per_m2,
                   m2 * {_double('1.75 - target')} AS saving_on_q1_volume_eur,
                   m2 * {_double('1.75 - target')} * 4 AS annualised_saving_eur
            FROM (SELECT {_total('b.area')} AS m2 FROM usage u{_BOX}
                  WHERE u.market = 'DE' AND {_QUARTER}),
                 (SELECT unnest([1.65, 1.55, 1.45, 1.35, 1.25]) AS target)""",
        "q10d_box_migration": f"""
            SELECT CAST(boxes AS INTEGER) AS monthly_pl_boxes, CAST(pct AS INTEGER) AS migration_pct,
                   boxes * pct / 100.0 AS boxes_migrated, {_double('m2 * rate')} AS saving_per_box_eur,
                   boxes * pct / 100.0 * {_double('m2 * rate')} AS monthly_saving_eur,
                   boxes * pct / 100.0 * {_double('m2 * rate')} * 12 AS annual_saving_eur,
                   boxes * pct / 100.0 * {_double('m2')} AS monthly_paper_saved_m2
            FROM (SELECT local_rate AS rate FROM rate WHERE market = 'DE' AND {on_day}),
                 (SELECT max(area) FILTER (pkg_id = 'P-L') - max(area) FILTER (pkg_id = 'P-M') AS m2
                  FROM box),
                 (SELECT unnest([500, 1000, 5000, 10000]) AS boxes),
                 (SELECT unnest([10, 20, 30]) AS pct)""",
        "q11_box_type_economics": f"""
            SELECT u.pkg_id, b.pkg_name, b.material_type, b.status AS pkg_status,
                   count(u.order_id) AS total_orders, {_total(_COST)} AS total_cost_eur,
                   {_mean(_COST)} AS avg_cost_per_order_eur, {_total(_WASTE)} AS total_paper_waste_m2,
                   {_mean(_WASTE)} AS avg_waste_per_order_m2, {_DAMAGE} AS damaged_orders,
                   {_DAMAGE_PCT} AS damage_rate_pct, {_mean_ratio(_EFFICIENCY)} AS avg_efficiency_pct,
                   {efficiency_of_sums} AS cost_efficiency_pct
            FROM {_PRICED} GROUP BY u.pkg_id, b.pkg_name, b.material_type, b.status""",
        "q12a_order_anomaly": f"""
            SELECT u.order_id, u.market, u.pkg_id, b.pkg_name, b.status AS pkg_status, u.meals_count,
                   u.order_date, u.is_damaged, {_double('b.area')} AS actual_area_m2,
                   {_double('k.eur')} AS cost_per_m2_eur, {_double(_COST)} AS actual_cost_eur,
                   round_even({_double(_COST)}, 0) AS apparent_cpm_eur,
                   'No standard defined for 12 meals' AS standards_gap
            FROM usage u{_BOX}{_RATE} WHERE u.meals_count = 12""",
        # The labels and scenarios of q12b, q12c are fixed values, as in the reports.
        "q12b_box_scenarios": f"""
            SELECT scenario, box_config, {_double('m2')} AS surface_area_m2,
                   {_double('round(m2 * eur, 4)')} AS cost_eur,
                   round({_double('m2 * eur')} / 12, 4) AS cost_per_meal_eur, food_risk
            FROM (SELECT max(eur) AS eur FROM rate WHERE market = 'UK' AND {on_day}),
                 (SELECT scenario, box_config, food_risk, sum(pieces * area) AS m2
                  FROM (VALUES
                      ('Actual #9005', '1× P-S', 'Critical — severe under-boxing', 'P-S', 1),
                      ('1× P-L (6 meals max)', '1× P-L', ' Moderate — still insufficient', 'P-L', 1),
                      ('Correct: 2× P-L', '2× P-L', ' Acceptable — two 6-meal boxes', 'P-L', 2),
                      ('Alt: P-XL + P-M', '1× P-XL + 1× P-M', ' Uses discontinued P-XL stock', 'P-XL', 1),
                      ('Alt: P-XL + P-M', '1× P-XL + 1× P-M', ' Uses discontinued P-XL stock', 'P-M', 1)
                  ) AS packing(scenario, box_config, food_risk, pkg_id, pieces)
                  JOIN box USING (pkg_id) GROUP BY ALL)""",
        "q12c_standards_gap": f"""
            SELECT u.meals_count, s.recommended_pkg_id,
                   CASE WHEN s.recommended_pkg_id IS NULL
                        THEN 'NO STANDARD — box assignment undefined' ELSE 'Standard defined'
                   END AS standards_status,
                   count(u.order_id) AS affected_orders
            FROM usage u{_STANDARD} GROUP BY u.meals_count, s.recommended_pkg_id""",
        "q13_master_metrics": f"""
            SELECT count(u.order_id) AS total_clean_orders, {_count_of('u.meals_count')} AS total_meals,
                   {_total(_COST)} AS total_actual_cost_eur,
                   {_total(_IDEAL_OR_COST)} AS total_ideal_cost_eur,
                   {_total(_COST)} - {_total(_IDEAL_OR_COST)} AS total_cost_inefficiency_eur,
                   {_pct(f'({_total(_COST)} - {_total(_IDEAL_OR_COST)})', _total(_COST))}
                       AS pct_spend_wasted,
                   {efficiency_of_sums} AS overall_cost_efficiency_pct,
                   {_total(_COST)} / {_count_of('u.meals_count')} AS overall_actual_cpm_eur,
                   {_total(_IDEAL_OR_COST)} / {_count_of('u.meals_count')} AS overall_ideal_cpm_eur,
                   {_total(_WASTE)} AS total_paper_waste_m2, {_mean(_WASTE)} AS avg_waste_per_order_m2,
                   {_OVER_COUNT} AS overboxed_orders, {_OVER_PCT} AS overboxing_rate_pct,
                   {_DAMAGE} AS damaged_orders, {_DAMAGE_PCT} AS overall_damage_rate_pct,
                   (SELECT count(*) FROM usage WHERE pkg_id IS NULL) AS null_pkg_id_orders,
                   (SELECT count(*) - count(DISTINCT order_id) FROM usage WHERE pkg_id IS NOT NULL)
                       AS duplicate_order_rows
            FROM {_PRICED}""",
        "qf1_financial_variance": f"""
            SELECT u.market, count(u.order_id) AS order_count, {_total('b.area')} AS total_surface_m2,
                   {_total(_COST)} AS total_cost_eur
            FROM usage u{_BOX}{_RATE} WHERE {_QUARTER} GROUP BY u.market""",
        "qf2_overboxing_gap": f"""
            SELECT u.market, count(*) AS overboxed_orders, {_total(_WASTE)} AS total_paper_waste_m2,
                   {_total(wasted)} AS total_cost_inefficiency_eur
            FROM usage u{_BOX}{_REC}{_RATE} WHERE {_QUARTER} AND {_OVER} GROUP BY u.market""",
    }


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {_SOURCE} {query}" for name, query in reports().items()}
