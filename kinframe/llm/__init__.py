"""Training-data operators: each module is one operator, ``queries`` binds them to the driver tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
