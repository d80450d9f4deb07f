"""Operators for preparing training data: text documents in, decisions or encodings out.

Every module holds one operator; ``queries`` and ``oracle`` register them for the driver.
Nothing outside this subpackage imports it.
"""
