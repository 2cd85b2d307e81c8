"""textpulse.plans"""
