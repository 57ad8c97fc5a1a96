"""Training-data operators: ten corpus-scale operators and their registered queries.

Each module holds one operator with a general interface; ``queries`` holds the thin ``opN_`` wrappers.
Nothing outside this subpackage imports it.
"""
