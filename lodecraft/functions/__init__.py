"""lodecraft.functions"""
