"""ledgerloom: a PySpark engine for company financials, filings and call transcripts."""
