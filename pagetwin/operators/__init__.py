"""pagetwin.operators"""
