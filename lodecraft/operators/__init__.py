"""lodecraft.operators"""
