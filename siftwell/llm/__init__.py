"""Training-data operators: token counts, licences, decontamination, language,
toxicity, SimHash, media columns, URL filters, packing and WARC derivatives.

Nothing else in the package imports this subpackage.
"""
