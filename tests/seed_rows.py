"""The sample input, as CSV text (see FIXTURES.md section 1)."""

WITH_BOM = {"dim_packaging_master", "dim_packaging_standards", "fact_box_usage"}

FILES = {
    "dim_packaging_master": """\
pkg_id,pkg_name,material_type,surface_area,unit_of_measure,status
P-S,Small Box,Recycled Paper,0.55,m2,Active
P-M,Medium Box,Corrugated,8500,cm2,Active
P-L,Large Box,Corrugated,1.3,m2,Active
P-XL,Extra Large,Cardboard,1.85,m2,Discontinued
""",
    "dim_packaging_standards": """\
meals_count,recommended_pkg_id
2,P-S
4,P-M
6,P-L
""",
    "dim_procurement_cost": """\
market,material_type,cost_per_m2,currency,valid_from,valid_to
DE,Recycled Paper,1.15,EUR,2025-01-01,2025-12-31
DE,Recycled Paper,1.75,EUR,2026-01-01,9999-12-31
UK,Corrugated,1.1,GBP,2025-01-01,9999-12-31
NL,Corrugated,1.25,EUR,2025-01-01,9999-12-31
""",
    "fact_box_usage": """\
order_id,market,pkg_id,meals_count,order_date,is_damaged
8001,DE,P-S,2,2025-11-10,0
8002,UK,P-M,4,2025-11-12,0
9001,DE,P-S,2,2026-01-10,0
9002,DE,P-L,2,2026-01-11,0
9003,UK,P-XL,6,2026-01-12,0
9004,NL,NULL,4,2026-01-15,0
9002,DE,P-L,2,2026-01-11,0
9005,UK,P-S,12,2026-01-22,0
9006,DE,P-M,4,2026-02-01,1
""",
}
