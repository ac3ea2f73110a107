"""Ticketloom: labelled multilingual short-text analytics on Spark DataFrames."""
