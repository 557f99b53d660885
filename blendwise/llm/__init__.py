"""Operators of a training-data pipeline (language ID, dedup, packing, sharding, WARC, chat, ...).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
