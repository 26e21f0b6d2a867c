"""lodecraft.streaming"""
