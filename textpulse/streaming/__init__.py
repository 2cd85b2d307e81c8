"""textpulse.streaming"""
