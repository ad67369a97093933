from .tables import (
    TableSet,
    bounded_sample,
    column_samples,
    full_scan,
    load_catalog,
    load_csv,
    load_jdbc,
    load_table_set,
    missing_norm,
    row_counts,
    semantic_sample,
    total_rows,
)

__all__ = [
    "TableSet",
    "bounded_sample",
    "column_samples",
    "full_scan",
    "load_catalog",
    "load_csv",
    "load_jdbc",
    "load_table_set",
    "missing_norm",
    "row_counts",
    "semantic_sample",
    "total_rows",
]
