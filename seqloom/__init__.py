"""Sequence analytics on Spark: clip catalogues, leak-proof splits, landmark
feature windows, motion segmentation, prediction reports and gloss sentences."""
