"""lumenrank.plans"""
