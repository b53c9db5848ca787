"""Training-data operators: token counts, packing, near-duplicates, decontamination and the like.

Nothing else in the library imports this subpackage.
"""
