"""DuckDB SQL of the queries, as registered beside them."""

from gridlark.plans.queries import ORACLE

__all__ = ["ORACLE"]
