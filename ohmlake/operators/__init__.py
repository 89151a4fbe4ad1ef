"""Operators over tables of electronics designs, datasheets, crawls and device registries.

Every operator takes whole tables and gives a DataFrame; a lookup by one key is a join with a table of keys.
"""
