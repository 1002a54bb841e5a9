"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` binds them
to the test tables and ``sql`` holds the SQL the results are compared with.
Nothing outside this subpackage imports it.
"""
