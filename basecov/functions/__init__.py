"""SQL expressions as text.

Every function takes expressions (mostly column names) and returns an expression, for use in ``expr``,
``selectExpr`` and SQL. Text composes without one call into the JVM per operator, which matters for the larger
formulas here; Catalyst sees the same expressions either way.
"""
