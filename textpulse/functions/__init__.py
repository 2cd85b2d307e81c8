"""textpulse.functions"""
