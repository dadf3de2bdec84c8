"""Operators of a training-data pipeline over text: archives, tokens, duplicates, quality, language, licences.

Nothing else in the library imports this package.  Every operator takes named columns of a DataFrame and selects
them first under names of its own, so extra columns (also ones named like a result) never clash.
"""
