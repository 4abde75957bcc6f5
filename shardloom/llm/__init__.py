"""Operations for large training-data pipelines: one module per operator.

Each module has an operator with a general interface and a thin ``opN_<name>``
query on top of it.  ``catalog.py`` lists the queries and their SQL.
"""
