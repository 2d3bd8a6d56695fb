"""The six logical tables: types, required columns, decimals and options as metadata."""

from __future__ import annotations

from pyspark.sql import types as T

ELIGIBILITY = ["Unscored", "Approved", "Manual Review", "Scored Rejected", "Gate Failed", "Manually Approved", "Manually Blocked", "Inactive"]
REVIEW = ["Unscored", "Shortlisted", "Manual Review", "Scored Rejected", "Gate Failed", "Excluded By Supplier", "Manually Approved", "Manually Rejected"]
SELECTION = ["Not Selected", "Initial Candidate", "New Arrivals Candidate", "Selected", "Pinned", "Published", "Archived"]


def _f(name: str, kind: T.DataType, required: bool = False, **meta) -> T.StructField:
    return T.StructField(name, kind, not required, meta)


def _num(name: str, decimals: int) -> T.StructField:
    return _f(name, T.DecimalType(18, decimals), decimals=decimals)


S, B, D, L = T.StringType(), T.BooleanType(), T.TimestampType(), T.ArrayType(T.StringType())
TABLES: dict[str, T.StructType] = {
    "suppliers": T.StructType([_f("supplier_key", S, True), _f("supplier_name", S, True), _f("supplier_url", S), _f("location_country", S), _f("ships_to_countries", L), _f("dispatch_countries", L), _num("shipping_max_days", 0), _num("supplier_rating", 2), _num("review_count", 0), _num("relevant_product_count", 0), _num("data_completeness_pct", 1), _f("shipping_policy_available", B), _f("return_policy_available", B), _f("approval_required", B), _f("active", B), _num("supplier_score", 1), _f("eligibility", S, options=ELIGIBILITY), _f("reasons", L), _f("manual_override", S, options=["None", "Approve", "Block"]), _f("first_seen_at", D), _f("last_seen_at", D), _f("fingerprint", S), _f("raw", S)]),
    "products": T.StructType([_f("product_key", S, True), _f("product_name", S, True), _f("supplier_key", S), _f("description", S), _f("brand", S), _f("category", S), _f("subcategory", S), _f("currency", S), _num("supplier_price", 2), _num("shipping_cost", 2), _num("suggested_retail_price", 2), _num("retail_price", 2), _num("landed_cost", 2), _num("margin_amount", 2), _num("margin_pct", 1), _f("margin_status", S, options=["Incomplete", "Below Minimum", "Acceptable", "Target Met"]), _num("product_score", 1), _f("review_status", S, options=REVIEW), _f("selection_status", S, options=SELECTION), _f("collection", S), _f("stock_status", S, options=["In Stock", "Out Of Stock", "Low Stock", "Unknown"]), _num("stock_quantity", 0), _f("image_urls", L), _f("main_image_url", S), _f("reasons", L), _f("risk_flags", L), _f("is_new", B), _f("active", B), _f("first_seen_at", D), _f("last_seen_at", D), _f("changed_at", D), _f("enriched_at", D), _f("fingerprint", S), _f("raw", S)]),
    "runs": T.StructType([_f("run_id", S, True), _f("kind", S, options=["Full Scan", "Incremental", "Reconcile"]), _f("status", S, options=["Running", "Completed", "Partial", "Failed"]), _f("completeness", S), _f("cursor", S), _num("pages", 0), _num("seen", 0), _num("created", 0), _num("updated", 0), _num("unchanged", 0), _num("failed", 0), _f("config_hash", S), _f("version", S), _f("started_at", D), _f("ended_at", D), _f("error", S)]),
    "changes": T.StructType([_f("log_id", S, True), _f("product_key", S, True), _f("change_type", S), _f("changed_fields", L), _f("old_values", S), _f("new_values", S), _f("run_id", S), _f("detected_at", D)]),
    "decisions": T.StructType([_f("decision_id", S, True), _f("key", S, True), _f("decision", S, options=["Approve", "Reject", "Block", "Clear"]), _f("previous_status", S), _f("new_status", S), _f("actor", S), _f("note", S), _f("decided_at", D)]),
    "batches": T.StructType([_f("batch", S, True), _f("kind", S, options=["Initial Assortment", "New Arrivals"]), _num("total", 0), _f("members", S), _f("notes", S), _f("created_at", D)]),
}
