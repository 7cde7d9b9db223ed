"""Training-data operators: quality, dedup, decontamination, packing, extraction, archives, language models.

Nothing else in the library imports this subpackage. Every operator reads the columns it is told to,
under private names, so extra columns of any name never clash with its own.
"""
