"""Operations of a training-data pipeline: tokenising, filtering, near duplicates, mixing.

Nothing outside this subpackage imports it.  Each module is one operator with
its own interface; ``queries`` binds them to the registered queries.
"""
