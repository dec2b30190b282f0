"""aerokpi.sources"""
