"""Training-data operators: formatting, filtering, deduplication, mixing and packing of text corpora.

Nothing outside this subpackage imports it. Every module holds one operator with its own general
interface; ``queries`` binds them to the tables of a data folder.
"""
