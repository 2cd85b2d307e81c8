"""textpulse.operators"""
