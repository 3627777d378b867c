"""Operators over catalogs, registries, site inventories and linked selections."""
