"""DataFrame operators.

A *series* here is a table with one row per product and week: product_id, week_end (Sunday),
demand (null for a week without data). Raw facts are summed or reduced to that grain before
any window runs, so a window partition holds at most the weeks of the calendar, however many
raw rows a product has.
"""
