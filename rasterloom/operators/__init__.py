"""rasterloom.operators"""
