"""rasterloom.streaming"""
