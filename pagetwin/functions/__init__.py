"""pagetwin.functions"""
