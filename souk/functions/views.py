"""The named views over the stored tables, as data."""

from __future__ import annotations

# Table -> view -> (column, kind of filter, value).
VIEWS = {
    "suppliers": {
        "Supplier Review": ("eligibility", "equals", "Manual Review"),
        "Approved Suppliers": ("eligibility", "equals", "Approved"),
        "Rejected Suppliers": ("eligibility", "equals", "Scored Rejected"),
        "Missing Shipping Data": ("shipping_max_days", "empty", None),
        "Manual Overrides": ("manual_override", "not_empty", None),
        "Inactive Suppliers": ("active", "is_false", None),
    },
    "products": {
        "All Active Products": ("active", "is_true", None),
        "New Products": ("is_new", "is_true", None),
        "Eligible Products": ("supplier_eligible", "is_true", None),
        "Excluded by Supplier": ("review_status", "equals", "Excluded By Supplier"),
        "Product Review": ("review_status", "equals", "Manual Review"),
        "Initial Assortment Candidates": ("selection_status", "equals", "Initial Candidate"),
        "New Arrival Candidates": ("selection_status", "equals", "New Arrivals Candidate"),
        "Missing Margin Data": ("margin_status", "equals", "Incomplete"),
        "High Risk": ("risk_flags", "not_empty", None),
        "Inactive Products": ("active", "is_false", None),
        "Published Products": ("selection_status", "equals", "Published"),
        "Publish Prep Gallery": ("selection_status", "equals", "Initial Candidate"),
        "Needs Attention": ("prep_status", "equals", "Needs Attention"),
    },
    "runs": {
        "Active Runs": ("status", "equals", "Running"),
        "Failed Runs": ("status", "equals", "Failed"),
        "Completed Runs": ("status", "equals", "Completed"),
        "Unverified Completeness": ("completeness", "equals", "Unverified"),
    },
}
