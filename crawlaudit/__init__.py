"""Crawl-scale web-page auditing as DataFrame-to-DataFrame operators."""
