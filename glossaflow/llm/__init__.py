"""Operators of a training-data pipeline over text corpora.

Each module holds one operator with a general interface; :mod:`.queries` has the
thin contract queries ``opN_<name>`` and :mod:`.oracles` their SQL.
"""
