"""Talent analytics on Spark: text statistics, matching, linkage and scoring over DataFrames."""
