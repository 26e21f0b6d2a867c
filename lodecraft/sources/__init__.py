"""lodecraft.sources"""
