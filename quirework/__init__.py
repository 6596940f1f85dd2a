"""quirework: document-corpus operators on Spark DataFrames.

Documents, pages, positioned text, outlines, metadata and run logs are plain
tables keyed by ``doc_id`` / ``page_no``; every operator takes DataFrames and
options and returns a DataFrame.
"""

__version__ = "0.1.0"
