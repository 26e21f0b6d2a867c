"""lodecraft.plans"""
