"""pagetwin.sources"""
