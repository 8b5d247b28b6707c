"""Relational operators that Spark lacks on plain tables: merge, identity allocation, paging, time spines, validation."""
