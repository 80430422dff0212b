"""Shared physical shapes: fused moments, frequency table, p-values, md5 orders."""
