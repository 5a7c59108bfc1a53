"""Table-to-table operators; every one returns a lazy DataFrame or Series."""
