"""lumenrank.streaming"""
