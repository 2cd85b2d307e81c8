"""textpulse.sources"""
