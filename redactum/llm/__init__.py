"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``queries`` holds what the driver
entry registers.
"""
