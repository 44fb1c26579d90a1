"""lumenrank.functions"""
