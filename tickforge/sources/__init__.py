"""Readers: quote files, filings, line files, and the driver's tables."""
