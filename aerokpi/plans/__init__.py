"""aerokpi.plans"""
