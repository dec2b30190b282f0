"""aerokpi.operators"""
