"""Training-data pipeline operators: ten corpus operators and their queries.

Nothing outside this subpackage imports it.  Every operator has its own
module with a general interface; ``queries`` holds the thin digest queries.
"""
