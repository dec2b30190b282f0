"""aerokpi.streaming"""
