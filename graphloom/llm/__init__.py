"""Training-data operators: one module per operator, all standing on ``tokens`` and ``shared``.

Nothing outside this subpackage imports it.  ``registry`` holds the queries and the SQL that
``__spark_entry__`` adds when this subpackage is there.
"""
