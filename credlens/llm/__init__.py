"""Training-data operators: ten operators and the corpus pipeline's stages.

Nothing else in the library imports this subpackage.
"""
