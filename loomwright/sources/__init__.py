"""Readers: Parquet datasets with positions, manifests, JSON, XML, text files, archives."""
