"""Training-data operators: each module holds one operator and its thin digest query.

Nothing outside this folder imports it; ``queries.QUERIES`` and ``queries.ORACLE_SQL`` list what it offers.
"""
