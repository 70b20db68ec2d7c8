"""pagetwin.plans"""
