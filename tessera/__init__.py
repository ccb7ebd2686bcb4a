"""Tessera: analytical operators for tables, text, signals and rasters, written as Spark plans."""
