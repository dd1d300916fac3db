"""Operators for preparing training data: mixing, extraction, archives, sharding, filters, scoring, de-duplication.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
package imports it.
"""
