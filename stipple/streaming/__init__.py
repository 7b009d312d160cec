"""Ordered batch delivery and incremental ingestion."""
