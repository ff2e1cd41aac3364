"""Catalogs of files and typed readers that yield ordered documents."""
