"""Reads and writes records of binary, bit-packed and text formats as typed, nested Spark columns."""
