"""lumenrank.operators"""
