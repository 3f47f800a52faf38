"""Operators for building training corpora. Nothing outside this folder imports it.

Every operator reads only the columns that it names, so further columns of any
name pass by; a null text counts as empty unless an operator says otherwise.
"""
