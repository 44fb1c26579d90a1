"""lumenrank.sources"""
